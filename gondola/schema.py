"""Declared schemas of the price-intelligence tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
S, I, L, D, B, TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _table(*fields: tuple) -> T.StructType:
    """(name, type) is required, (name, type, None) is nullable."""
    return T.StructType([T.StructField(f[0], f[1], len(f) > 2) for f in fields])


SUPERMARKETS = _table(
    ("id", L), ("name", S), ("slug", S), ("base_url", S, None), ("is_active", B), ("freshness_sla_hours", I),
)
PRODUCTS = _table(
    ("ean", S), ("name", S), ("brand", S, None), ("description", S, None), ("image_url", S, None),
    ("images", T.ArrayType(S), None), ("category", S, None),
)
SUPERMARKET_PRODUCTS = _table(
    ("id", L), ("product_ean", S), ("supermarket_id", L), ("price", MONEY, None), ("list_price", MONEY, None),
    ("reference_price", MONEY, None), ("reference_unit", S, None), ("is_available", B), ("sku_id", S, None),
    ("seller_id", S, None), ("product_url", S, None), ("last_checked_at", TS),
)
PRICE_HISTORY = _table(
    ("id", S), ("supermarket_product_id", L), ("price", MONEY, None), ("list_price", MONEY, None), ("scraped_at", TS),
)
PROMOTIONS = _table(
    ("id", L), ("supermarket_id", L), ("type", S), ("title", S), ("wallet_provider", S, None), ("bank_name", S, None),
    ("discount_value", MONEY, None), ("conditions", S, None), ("start_date", TS, None), ("end_date", TS, None),
    ("is_active", B),
)
PROMOTION_PRODUCTS = _table(("promotion_id", L), ("product_ean", S))
CATEGORIES = _table(("id", L), ("name", S), ("slug", S), ("parent_id", L, None), ("icon", S, None))
INGESTION_RUN = _table(
    ("id", L), ("batch_id", S), ("source_slug", S), ("started_at", TS), ("finished_at", TS, None), ("status", S),
    ("queries_sent", L), ("products_fetched", L), ("products_staged", L), ("products_promoted", L),
    ("products_rejected", L), ("error_summary", S, None), ("duration_ms", L, None),
)
STAGING_PRODUCT = _table(
    ("id", S), ("run_id", L), ("source_slug", S), ("ean", S), ("name", S), ("brand", S, None),
    ("description", S, None), ("image_url", S, None), ("images", T.ArrayType(S), None), ("category", S, None),
    ("sku_id", S, None), ("seller_id", S, None), ("product_url", S, None), ("price", T.DecimalType(18, 2), None),
    ("list_price", MONEY, None), ("reference_price", MONEY, None), ("reference_unit", S, None), ("is_available", B),
    ("quality_score", D), ("quality_flags", T.ArrayType(S)), ("status", S), ("created_at", TS),
)
SOURCE_HEALTH = _table(
    ("id", L), ("source_slug", S), ("checked_at", TS), ("is_healthy", B), ("response_time_ms", L),
    ("error_type", S, None), ("hash_valid", B), ("products_returned", L),
)
RUN_LEDGER = _table(
    ("run_key", S), ("source_slug", S), ("count", I), ("status", S), ("lineage", S, None), ("planned_at", TS),
    ("started_at", TS, None), ("finished_at", TS, None),
)

# Landed catalog payload of one product. Spellings that differ only in case are
# read through RAW_ALTERNATE, since one struct cannot hold both.
_IMAGE = T.StructType([T.StructField(n, S) for n in ("imageUrl", "imageLabel", "imageText")])
_REFERENCE = T.StructType([T.StructField("Value", S)])
_REFERENCE_LOWER = T.StructType([T.StructField("value", S)])
_OFFER = T.StructType([
    T.StructField("Price", S), T.StructField("ListPrice", S), T.StructField("PriceWithoutDiscount", S),
    T.StructField("AvailableQuantity", S), T.StructField("IsAvailable", S),
])
_SELLER = T.StructType([
    T.StructField("sellerId", S), T.StructField("id", S),
    T.StructField("commertialOffer", _OFFER), T.StructField("commercialOffer", _OFFER),
])
_ITEM = T.StructType([
    T.StructField("itemId", S), T.StructField("id", S), T.StructField("ean", S),
    T.StructField("referenceId", T.ArrayType(_REFERENCE)), T.StructField("images", T.ArrayType(_IMAGE)),
    T.StructField("sellers", T.ArrayType(_SELLER)), T.StructField("measurementUnit", S),
])
RAW_PRODUCT = T.StructType([
    *[T.StructField(n, S) for n in (
        "productId", "productName", "name", "brand", "brandName", "description", "metaTagDescription", "linkText",
        "link", "ean", "category", "price", "listPrice", "unitMultiplier", "measurementUnit", "available")],
    T.StructField("categories", T.ArrayType(S)),
    T.StructField("categoryTree", T.ArrayType(T.StructType([T.StructField("name", S)]))),
    T.StructField("referenceId", T.ArrayType(_REFERENCE)),
    T.StructField("images", T.ArrayType(_IMAGE)),
    T.StructField("items", T.ArrayType(_ITEM)),
    T.StructField("sellers", T.ArrayType(_SELLER)),
])

RAW_ALTERNATE = T.StructType([
    T.StructField("EAN", S), T.StructField("referenceId", T.ArrayType(_REFERENCE_LOWER)),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("EAN", S), T.StructField("referenceId", T.ArrayType(_REFERENCE_LOWER))]))),
])

TABLES = {
    "supermarkets": SUPERMARKETS, "products": PRODUCTS, "supermarket_products": SUPERMARKET_PRODUCTS,
    "price_history": PRICE_HISTORY, "promotions": PROMOTIONS, "promotion_products": PROMOTION_PRODUCTS,
    "categories": CATEGORIES, "ingestion_run": INGESTION_RUN, "staging_product": STAGING_PRODUCT,
    "source_health": SOURCE_HEALTH, "direct_refresh_run_ledger": RUN_LEDGER,
}
