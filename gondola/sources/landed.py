"""Landed JSON files: artifacts and payloads, with a quarantine for what cannot be read.

A file is one document (``whole``) or a document per line. Nothing stops a run:
a document that is empty, no JSON or of another shape becomes a quarantine row
with its file, reason and first characters, and all others go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from .payloads import deeper_than, find_product_records, has_products, once

BOM = "﻿"
EXCERPT = 40


def read_documents(spark: SparkSession, path: str, whole: bool = True, pattern: str = "*") -> DataFrame:
    """(file, bytes, body) of the files below ``path``: a row per file, or per line; a byte order mark is taken off.

    A whole file must fit a row (2 GB); of lines, empty ones are left out.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=whole)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    body = F.regexp_replace("value", f"^{BOM}", "")
    found = rows.select(name.alias("file"), F.octet_length("value").cast("bigint").alias("bytes"), body.alias("body"))
    return found if whole else found.where(F.trim("body") != "")


def _parsed(documents: DataFrame) -> DataFrame:
    return once(documents, "_d", v=F.try_parse_json("body")).withColumn("_v", F.col("_d.v")).drop("_d")


def _list_of(node: Column, path: str = "$") -> Column:
    return F.try_variant_get(node, path, "array<variant>")


def _candidates(v: Column) -> Column:
    return F.coalesce(_list_of(v), _list_of(v, "$.candidates"))


def _quarantine(documents: DataFrame, reason: Column) -> DataFrame:
    return once(documents, "_r", reason=reason).where(F.col("_r.reason").isNotNull()).select(
        "file", "bytes", "_r.reason", F.substring("body", 1, EXCERPT).alias("excerpt"))


def _unread(v: Column) -> Column:
    return F.when(F.trim("body") == "", "empty").when(v.isNull(), "not_json")


# -- artifacts -----------------------------------------------------------------------
def folded(text: Column) -> Column:
    return F.lower(clean(text))


def _values(node: Column, path: str) -> tuple[Column, Column]:
    """The distinct folded texts of a list, and whether the list is there and every entry is the same text."""
    entries = _list_of(node, path)
    texts = F.transform(entries, lambda e: folded(F.try_variant_get(e, "$", "string")))
    found = F.array_distinct(F.filter(texts, lambda t: t.isNotNull()))
    return found, F.coalesce((F.size(found) == 1) & (F.size(entries) == 1), F.lit(False))


def wrapper_defaults(v: Column) -> Column:
    """Struct source, surface, source_error, surface_error of a wrapper with ``candidates``.

    The source is the only entry of ``sources``; the surface is ``coverage.surface``, which counts only with a
    ``coverage.mode`` and where the lists ``modes`` and ``surfaces``, if given, hold just that value.
    """
    sources, one_source = _values(v, "$.sources")
    mode, surface = (folded(F.try_variant_get(v, f"$.coverage.{n}", "string")) for n in ("mode", "surface"))

    def conflict(single: Column, path: str) -> Column:
        found, one = _values(v, path)
        return _list_of(v, path).isNotNull() & (~one | F.coalesce(F.get(found, F.lit(0)) != single, F.lit(False)))

    clash = conflict(mode, "$.coverage.modes") | conflict(surface, "$.coverage.surfaces")
    missing = mode.isNull() | surface.isNull()
    return F.named_struct(
        F.lit("source"), F.when(one_source, F.get(sources, F.lit(0))), F.lit("surface"), F.when(~clash & ~missing, surface),
        F.lit("source_error"), F.when(~one_source, "wrapper_source"),
        F.lit("surface_error"), F.when(clash, "wrapper_coverage_conflict").when(missing, "wrapper_coverage"))


def artifact_candidates(documents: DataFrame) -> DataFrame:
    """Candidates of readable artifacts: the columns of ``documents`` but body, pos from 0, source, surface, errors, identity fields.

    An artifact is a list of candidates or a wrapper with ``candidates`` whose defaults fill an absent source or
    surface. ``errors`` says why a row has none; it is empty for complete rows.
    """
    keys = [c for c in documents.columns if c != "body"]
    v = F.col("_v")
    # per document, not per candidate
    read = once(_parsed(documents), "_e", w=F.when(_list_of(v).isNull(), wrapper_defaults(v)), c=_candidates(v))
    rows = read.select(*keys, F.col("_e.w").alias("_w"), F.posexplode("_e.c").alias("pos", "_c"))
    field = lambda n: F.try_variant_get("_c", f"$.{n}", "string")
    own_source, own_surface = folded(field("source")), folded(field("surface"))
    rows = once(rows, "_f", source=F.coalesce(own_source, "_w.source"), surface=F.coalesce(own_surface, "_w.surface"))
    rows = rows.withColumns({"source": F.col("_f.source"), "surface": F.col("_f.surface")})
    errors = F.filter(F.array(
        F.when(F.col("source").isNull(), F.coalesce("_w.source_error", F.lit("source_missing"))),
        F.when(F.col("surface").isNull(), F.coalesce("_w.surface_error", F.lit("surface_missing")))), lambda e: e.isNotNull())
    names = {"ean": "ean", "skuId": "sku_id", "productId": "product_id", "url": "url", "name": "name", "categoryPath": "category_path"}
    return rows.select(*keys, "pos", "source", "surface", errors.alias("errors"), *[field(n).alias(c) for n, c in names.items()])


def quarantined_artifacts(documents: DataFrame) -> DataFrame:
    """(file, bytes, reason, excerpt) of documents that are no artifact: empty, not_json, no_candidates."""
    v = F.col("_v")
    return _quarantine(_parsed(documents), F.coalesce(_unread(v), F.when(_candidates(v).isNull(), "no_candidates")))


# -- payloads ------------------------------------------------------------------------
def payload_records(documents: DataFrame) -> DataFrame:
    """Product records of readable payloads, with the columns of ``documents`` but body and pos within the document."""
    return find_product_records(documents.withColumnRenamed("body", "raw"))


def quarantined_documents(documents: DataFrame, max_depth: int = 10) -> DataFrame:
    """(file, bytes, reason, excerpt) of payloads that are empty, not_json, hold no_products, or are read but deeper than
    ``max_depth`` levels (deep)."""
    rows = _parsed(documents.withColumn("raw", F.col("body")))
    reason = F.coalesce(_unread(F.col("_v")), F.when(~has_products(F.col("_v")), "no_products"), F.when(deeper_than(max_depth, F.col("_v")), "deep"))
    return _quarantine(rows, reason)

