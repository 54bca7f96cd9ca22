"""Discovery of rows that do not exist yet: audit, create plan, rollback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.freshness import at
from ..functions.identity import idempotency_key
from ..functions.numeric import positive
from ..functions.quality import has_text
from ..functions.rules import reasons
from ..functions.text import has_broken_text
from ..functions.web import url_host

# Fixed value: the doubly encoded traces this audit looks for.
DOUBLE_BROKEN_PATTERN = "Ãƒ|Ã‚|ï¿½"

BOTH, SOURCE_ONLY = "product-and-source-discovery", "source-row-discovery"


def discovery_audit(live: DataFrame, products: DataFrame, current: DataFrame, pending: DataFrame, hosts: DataFrame,
                    pattern: str = DOUBLE_BROKEN_PATTERN) -> DataFrame:
    """Class and blockers of every distinct live candidate.

    ``current`` has source_slug, ean, sku_id; ``pending`` the staged (source_slug, ean).
    """
    known = products.select("ean", F.lit(True).alias("has_product"))
    own = current.select("source_slug", "ean", F.lit(True).alias("has_row")).distinct()
    skus = current.filter(has_text(F.col("sku_id"))).groupBy("source_slug", "sku_id").agg(F.count("*").alias("sku_rows"))
    waiting = pending.select("source_slug", "ean", F.lit(True).alias("is_pending")).distinct()
    joined = (
        live.join(known, "ean", "left").join(own, ["source_slug", "ean"], "left").join(waiting, ["source_slug", "ean"], "left")
        .join(skus, ["source_slug", "sku_id"], "left").join(hosts, "source_slug", "left"))
    checks = reasons([
        ("no_ean", ~has_text(F.col("ean"))), ("no_sku", ~has_text(F.col("sku_id"))), ("no_name", ~has_text(F.col("name"))),
        ("broken_text", has_broken_text(F.col("name"), pattern)), ("price_not_positive", ~positive(F.col("price"))),
        ("unavailable", ~F.coalesce("is_available", F.lit(False))),
        ("unexpected_host", ~F.coalesce(url_host(F.col("product_url")) == F.col("expected_host"), F.lit(False))),
        ("pending_staging_row", F.col("is_pending").isNotNull()), ("sku_in_use", F.coalesce("sku_rows", F.lit(0)) > 0)])
    kind = (F.when(F.col("has_row"), "already-covered").when(F.size("blockers") > 0, "blocked")
            .when(F.col("has_product"), SOURCE_ONLY).otherwise(BOTH))
    return joined.withColumn("blockers", checks).withColumn("classification", kind).withColumns({
        "blockers": F.when(F.col("has_row"), F.array(F.lit("source_row_exists"))).otherwise(F.col("blockers")),
        "idempotency_key": idempotency_key(F.col("source_slug"), F.col("ean"), F.col("sku_id"))})


def discovery_summary(audit: DataFrame) -> DataFrame:
    chosen = F.col("classification").isin(BOTH, SOURCE_ONLY)
    return audit.groupBy("source_slug").agg(
        F.count("*").alias("scanned"), F.count_if(chosen).alias("selected"),
        F.count_if(F.col("classification") == BOTH).alias("product_creates"), F.count_if(~chosen).alias("blocked"),
    ).withColumn("status", F.when(F.col("selected") > 0, "PASS").otherwise("WARN"))


def planned_creates(audit: DataFrame, now) -> dict[str, DataFrame]:
    """Insert plans per table; every row carries the key that a rollback needs.

    An EAN offered by several sources creates its product once, from the first source.
    """
    chosen = audit.filter(F.col("classification").isin(BOTH, SOURCE_ONLY))
    attributes = ["name", "brand", "description", "image_url", "category"]
    product = chosen.filter(F.col("classification") == BOTH).groupBy("ean").agg(
        F.min_by(F.struct("idempotency_key", *attributes), F.struct("source_slug", "idempotency_key")).alias("p")).select("ean", "p.*")
    row = chosen.select(
        "idempotency_key", "source_slug", "ean", "price", "list_price", "sku_id", "product_url", "is_available", "classification",
        at(now).alias("last_checked_at"))
    history = chosen.select("idempotency_key", "source_slug", "ean", "price", "list_price", at(now).alias("scraped_at"))
    return {"products": product, "supermarket_products": row, "price_history": history}


def apply_races(rows: DataFrame, products: DataFrame, current: DataFrame, pending: DataFrame) -> DataFrame:
    """Reasons that appeared between planning and applying, per planned row."""
    known = products.select("ean", F.lit(True).alias("p"))
    own = current.select("source_slug", "ean", F.lit(True).alias("r")).distinct()
    waiting = pending.select("source_slug", "ean", F.lit(True).alias("w")).distinct()
    skus = current.filter(has_text(F.col("sku_id"))).select("source_slug", "sku_id", F.lit(True).alias("s")).distinct()
    joined = (
        rows.join(known, "ean", "left").join(own, ["source_slug", "ean"], "left").join(waiting, ["source_slug", "ean"], "left")
        .join(skus, ["source_slug", "sku_id"], "left"))
    checks = reasons([
        ("product_exists", (F.col("classification") == BOTH) & F.col("p").isNotNull()),
        ("product_missing", (F.col("classification") == SOURCE_ONLY) & F.col("p").isNull()),
        ("source_row_exists", F.col("r").isNotNull()), ("pending_staging_row", F.col("w").isNotNull()), ("sku_in_use", F.col("s").isNotNull())])
    return joined.select("idempotency_key", "source_slug", "ean", checks.alias("reasons"))


def rollback_tables(plans: dict[str, DataFrame], tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Tables without the created rows; children come first in ``plans`` order."""
    return {name: tables[name].join(plans[name].select(*keys[name]).distinct(), keys[name], "left_anti") for name in plans}


def rollback_report(plans: dict[str, DataFrame], before: dict[str, DataFrame], after: dict[str, DataFrame],
                    keys: dict[str, list[str]]) -> DataFrame:
    """Per table: planned keys, rows removed, rows left behind, and whether the rollback is complete.

    Planned, earlier and later rows of all tables meet in one aggregation by (table, key).
    """
    def tagged(rows: DataFrame, name: str, tag: str) -> DataFrame:
        key = F.to_json(F.struct(*keys[name]))
        return rows.select(F.lit(name).alias("table"), key.alias("key"), *[F.lit(int(t == tag)).alias(t) for t in ("planned", "present", "remaining")])

    every = reduce(DataFrame.unionAll, [tagged(rows, name, tag) for name in plans for rows, tag in (
        (plans[name], "planned"), (before[name], "present"), (after[name], "remaining"))])
    by_key = every.groupBy("table", "key").agg(F.max("planned").alias("planned"), F.sum("present").alias("present"), F.sum("remaining").alias("remaining"))
    rows = by_key.groupBy("table").agg(F.sum("planned").alias("planned"), *[
        F.sum(F.col(c) * F.col("planned")).alias(c) for c in ("present", "remaining")])
    return rows.withColumn("deleted", F.col("present") - F.col("remaining")).withColumns({
        "planned": F.col("planned").cast("bigint")}).withColumn(
        "status", F.when((F.col("deleted") != F.col("planned")) | (F.col("remaining") > 0), "FAIL").otherwise("PASS"))


def created_row_audit(plan: DataFrame, actual: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Planned creates against the rows found: missing, extra or differing columns per key."""
    p = plan.select(*keys, F.struct(*columns).alias("plan"))
    a = actual.select(*keys, F.struct(*columns).alias("actual"))
    joined = p.join(a, keys, "full_outer")
    both = F.col("plan").isNotNull() & F.col("actual").isNotNull()
    checks = reasons([
        ("missing", F.col("actual").isNull()), ("unexpected", F.col("plan").isNull()),
        *[(f"{c}_differs", both & ~F.col(f"plan.{c}").eqNullSafe(F.col(f"actual.{c}"))) for c in columns]])
    return joined.select(*keys, checks.alias("reasons"))
