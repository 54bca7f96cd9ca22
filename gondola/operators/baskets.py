"""Shopping baskets at scale: cleaning, lookup, totals per store, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import freshness as fr
from ..functions.numeric import half_up
from ..functions.text import trim_space

MIN_QTY, MAX_QTY = 1, 99


def _clamp(qty: Column) -> Column:
    return F.least(F.lit(MAX_QTY), F.greatest(F.lit(MIN_QTY), half_up(qty, 0).cast("bigint")))


def sanitize_baskets(lines: DataFrame) -> DataFrame:
    """Valid lines with clamped quantities, one per (basket, EAN), clamped again after the sum."""
    qty, ean = F.col("qty").cast("double"), trim_space(F.col("ean"))
    valid = ean.rlike(r"^\d{8,18}$") & (qty > 0) & ~F.isnan(qty) & (qty != F.lit(float("inf")))
    return (
        lines.filter(valid)
        .groupBy("basket_id", ean.alias("ean")).agg(F.sum(_clamp(qty)).alias("qty"))
        .withColumn("qty", _clamp(F.col("qty").cast("double")))
    )


def lookup_products(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct requested EANs in first-request order, found or missing."""
    wanted = requests.groupBy("request_id", "ean").agg(F.min("ord").alias("ord"))
    known = products.select("ean", "name")
    return wanted.join(known, "ean", "left").select(
        "request_id", "ord", "ean", F.col("name").isNotNull().alias("found"), "name")


def basket_totals(lines: DataFrame, products: DataFrame, entries: DataFrame) -> DataFrame:
    """Covered and missing lines and the total per (basket, store).

    A line is covered by a fresh, available price. Stores covering nothing are
    dropped, so only covered pairs need to be formed; the missing count is the
    basket's number of known lines minus the covered ones.
    """
    known = lines.join(products.select("ean"), "ean", "left_semi")
    sizes = known.groupBy("basket_id").agg(F.count("*").alias("lines"))
    offers = entries.filter(F.col("price").isNotNull() & F.col("is_available") & (F.col("status") == fr.FRESH)).select(
        F.col("product_ean").alias("ean"), "slug", "price")
    covered = (
        known.join(offers, "ean")
        .groupBy("basket_id", "slug")
        .agg(F.count("*").alias("covered_items"),
             F.sum(F.col("price") * F.col("qty").cast("decimal(4,0)")).cast("double").alias("total"))
    )
    return covered.join(sizes, "basket_id").select(
        "basket_id", "slug", "covered_items", (F.col("lines") - F.col("covered_items")).alias("missing_items"), "total")


def rank_stores(totals: DataFrame) -> DataFrame:
    """Stores of a basket by missing items, then total; flags the best complete one.

    The window holds one row per store and basket, so it is bounded by the number of stores.
    """
    order = Window.partitionBy("basket_id").orderBy("missing_items", "total", "slug")
    return totals.withColumn("position", F.row_number().over(order).cast("bigint")).withColumn(
        "best_complete", (F.col("position") == 1) & (F.col("missing_items") == 0))


def basket_product_prices(lines: DataFrame, products: DataFrame, entries: DataFrame) -> DataFrame:
    """Per requested EAN the available and fresh minimum and the ordered entry list (one per store)."""
    wanted = lines.select("ean").distinct()
    ok = F.col("is_available") & F.col("price").isNotNull()
    fresh = ok & (F.col("status") == fr.FRESH)
    price = F.col("price").cast("double")
    entry = F.struct("slug", "id", price.alias("price"), "is_available", "status")
    grouped = entries.groupBy(F.col("product_ean").alias("ean")).agg(
        F.min(F.when(ok, price)).alias("min_price"), F.min(F.when(fresh, price)).alias("fresh_min_price"),
        F.sort_array(F.collect_list(entry)).alias("price_entries"))
    return (
        products.select("ean", "name", "brand").join(wanted, "ean", "left_semi").join(grouped, "ean", "left")
        .withColumn("has_fresh", F.col("fresh_min_price").isNotNull())
        .withColumn("price_entries", F.coalesce("price_entries", F.expr("array()")))
    )
