"""URL and fetch-outcome rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def _has_scheme(url: Column) -> Column:
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\s]")


def url_host(url: Column) -> Column:
    """Lower-case host with its port, one leading ``www.`` removed; null when invalid."""
    authority = F.regexp_replace(F.lower(_part(url, "AUTHORITY")), "^.*@", "")
    return F.when(_has_scheme(url), F.nullif(F.regexp_replace(authority, r"^www\.", ""), F.lit("")))


def normalized_product_url(url: Column) -> Column:
    """Host name and path in lower case without trailing slashes; otherwise the text up to ? or #."""
    text = F.lower(F.trim(url))
    host_and_path = F.regexp_replace(
        text, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)(?::\d*)?([^?#]*?)/*(?:[?#].*)?$", "$1$2")
    parsed = F.regexp_replace(host_and_path, "^([^/]+)$", "$1/")
    plain = F.regexp_replace(text, "/*(?:[?#].*)?$", "")
    return F.when(text != "", F.when(_has_scheme(text), parsed).otherwise(plain))


def absolute_url(path: Column, base: Column) -> Column:
    """Absolute addresses pass; rooted and bare paths are resolved against the site root."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return (
        F.when(path.startswith("http"), path)
        .when(path.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), path))
        .when(path.startswith("/"), F.concat(origin, path))
        .otherwise(F.concat(origin, F.lit("/"), path))
    )
