"""Identities, keys and stable hashes of candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean
from .web import normalized_product_url


def folded(text: Column) -> Column:
    return F.lower(clean(text))


def candidate_identity(**fields: Column) -> Column:
    """(kind, value) of the first non-blank field in the given order; null when all are blank."""
    return F.coalesce(*[
        F.when(folded(value).isNotNull(), F.struct(F.lit(kind).alias("kind"), folded(value).alias("value")))
        for kind, value in fields.items()])


def canonical_identity(sku: Column, url: Column, ean: Column, kind: Column, identity: Column, name: Column,
                       otherwise: Column | None = None) -> Column:
    """SKU, URL, EAN, then the given identity, then the name, else ``otherwise`` or a hash of these fields."""
    def tagged(tag: str, value: Column) -> Column:
        return F.concat(F.lit(f"{tag}:"), value)

    everything = F.sha2(F.to_json(F.struct(
        sku.alias("sku"), url.alias("url"), ean.alias("ean"), kind.alias("kind"), identity.alias("identity"), name.alias("name"))), 256)
    return F.coalesce(
        tagged("sku", folded(sku)), tagged("url", normalized_product_url(url)), tagged("ean", folded(ean)),
        F.concat(folded(kind), F.lit(":"), folded(identity)), tagged("name", folded(name)),
        tagged("hash", everything) if otherwise is None else otherwise)


def idempotency_key(source: Column, ean: Column, sku: Column, limit: int = 120) -> Column:
    """discovery:source:ean:sku, hashed when longer than ``limit``."""
    key = F.concat(F.lit("discovery:"), source, F.lit(":"), ean, F.lit(":"), F.coalesce(sku, F.lit("no-sku")))
    return F.when(F.length(key) > limit, F.concat(F.lit("discovery:"), F.sha2(key, 256))).otherwise(key)


def source_lock_key(source: Column) -> Column:
    """Positive 31-bit number from the first four bytes of the source's SHA-256."""
    bits = F.conv(F.substring(F.sha2(source, 256), 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF))
    return F.when(bits == 0, 1).otherwise(bits)


def record_hash(names: list[str], arrays: tuple[str, ...] = ()) -> Column:
    """SHA-256 of a canonical text: names sorted, numbers with four decimals, arrays sorted, nulls explicit."""
    parts = []
    for name in sorted(names):
        value = F.array_join(F.array_sort(F.col(name)), ",") if name in arrays else F.col(name).cast("string")
        parts.append(F.concat(F.lit(f"{name}="), F.coalesce(value, F.lit("~"))))
    return F.sha2(F.concat_ws("|", *parts), 256)


def four_decimals(value: Column) -> Column:
    return value.cast("decimal(18,4)").cast("string")

