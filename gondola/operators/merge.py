"""Batch merge of candidates into products, current prices and history.

One batch is one unit: every plan is computed from the same snapshot, at most
one history row per (product, store) and batch is added (that of the last
candidate), and the tables are rewritten as new snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.freshness import at
from ..functions.quality import has_items, has_text
from ..sources import versions

KEY = ["product_ean", "supermarket_id"]
PRICE_COLUMNS = ["price", "list_price", "reference_price", "reference_unit", "is_available", "sku_id", "seller_id", "product_url"]
FILL_COLUMNS = ["brand", "description", "image_url", "category"]


def preflight_violations(candidates: DataFrame, products: DataFrame, current: DataFrame, supermarkets: DataFrame) -> DataFrame:
    """Rows that would have to be created: unknown products, and unknown (product, store) rows."""
    asked = candidates.groupBy("ean", "source_slug").agg(F.count("*").alias("rows"))
    missing = asked.join(products.select("ean"), "ean", "left_anti").groupBy("ean").agg(F.lit(1).cast("bigint").alias("rows"))
    stores = supermarkets.select(F.col("slug").alias("source_slug"), F.col("id").alias("supermarket_id"))
    known = current.select(F.col("product_ean").alias("ean"), "supermarket_id").join(stores, "supermarket_id").select("ean", "source_slug")
    return (
        missing.select(F.lit("missing_product").alias("reason"), "ean", F.lit(None).cast("string").alias("source_slug"), "rows")
        .unionByName(asked.join(known, ["ean", "source_slug"], "left_anti").select(
            F.lit("missing_store_row").alias("reason"), "ean", "source_slug", "rows"))
    )


def new_products(canonical: DataFrame, products: DataFrame) -> DataFrame:
    return canonical.join(products.select("ean"), "ean", "left_anti").select(
        "ean", "name", "brand", "description", "image_url", "images", "category")


def protective_merge(products: DataFrame, canonical: DataFrame) -> DataFrame:
    """Products with blanks filled from the canonical candidate; the name never changes."""
    fresh = canonical.select("ean", *[F.col(c).alias(f"new_{c}") for c in [*FILL_COLUMNS, "images"]])
    joined = products.join(fresh, "ean", "left")
    fill, changed = {}, F.lit(False)
    for c in [*FILL_COLUMNS, "images"]:
        full = has_items if c == "images" else has_text
        take = ~full(F.col(c)) & full(F.col(f"new_{c}"))
        fill[c] = F.when(take, F.col(f"new_{c}")).otherwise(F.col(c))
        changed = changed | take
    return joined.withColumn("changed", changed).withColumns(fill).select(
        *[c for c in products.columns], "changed")


SHORTEST_EAN, LONGEST_EAN = 8, 14


def is_ean(ean: Column) -> Column:
    return F.coalesce(ean.rlike(rf"^[0-9]{{{SHORTEST_EAN},{LONGEST_EAN}}}\z"), F.lit(False))


def created_id(ean: Column, store: Column) -> Column:
    """Id of a row the merge creates: one for each EAN text and store, the same in every rerun, below all ids given
    elsewhere; null where the text is no EAN.

    Leading zeros make different texts: texts are numbered by length first, so those of one length follow all shorter
    ones. That takes under 1.2e14 numbers, which fit the negative 64-bit range with a store number of 16 bits.
    """
    shorter = F.lit(0).cast("bigint")
    for digits in range(SHORTEST_EAN, LONGEST_EAN):
        shorter = shorter + F.when(F.length(ean) > digits, F.lit(10 ** digits)).otherwise(F.lit(0))
    number = F.when(is_ean(ean), ean.try_cast("bigint") + shorter)
    return F.when((store >= 0) & (store < (1 << 16) - 1), -(number * F.lit(1 << 16) + store + 1))


def _store_ids(winners: DataFrame, supermarkets: DataFrame) -> DataFrame:
    stores = supermarkets.select(F.col("slug").alias("source_slug"), F.col("id").alias("supermarket_id"))
    return winners.join(stores, "source_slug").withColumnRenamed("ean", "product_ean")


def upsert_current(current: DataFrame, winners: DataFrame, supermarkets: DataFrame, now) -> DataFrame:
    """Current prices after the batch, with the action taken per row; a row that cannot be created is left out."""
    new = _store_ids(winners, supermarkets).select(*KEY, F.struct(*PRICE_COLUMNS).alias("new"))
    joined = current.join(new, KEY, "full_outer")
    hit = F.col("new").isNotNull()
    values = {c: F.when(hit, F.col(f"new.{c}").cast(current.schema[c].dataType)).otherwise(F.col(c)) for c in PRICE_COLUMNS}
    action = F.when(~hit, "keep").when(F.col("id").isNull(), "insert").otherwise("update")
    return joined.withColumns({
        "action": action, **values, "id": F.coalesce("id", created_id(F.col("product_ean"), F.col("supermarket_id"))),
        "last_checked_at": F.when(hit, at(now)).otherwise(F.col("last_checked_at")),
    }).filter(F.col("id").isNotNull()).drop("new")


def refused_creations(winners: DataFrame, current: DataFrame, supermarkets: DataFrame) -> DataFrame:
    """Winners without a stored row whose EAN text or store number gives no id: (product_ean, supermarket_id)."""
    rows = _store_ids(winners.select("ean", "source_slug"), supermarkets).select(*KEY)
    return rows.filter(created_id(F.col("product_ean"), F.col("supermarket_id")).isNull()).join(current.select(*KEY), KEY, "left_anti")


def merge_current(root: str, winners: DataFrame, supermarkets: DataFrame, now, version: int | None = None) -> versions.Manifest:
    """The batch merged into the bucketed table of current prices at ``root``, as a new version of the buckets it touches."""
    stores = supermarkets.select(F.col("slug").alias("source_slug"), F.col("id").alias("supermarket_id"))
    changes = winners.join(stores, "source_slug").withColumn("product_ean", F.col("ean"))
    return versions.merge(changes, root, lambda held, new: upsert_current(
        held, new.drop("product_ean", "supermarket_id"), supermarkets, now), version)


def planned_rows(winners: DataFrame, last: DataFrame, supermarkets: DataFrame, current: DataFrame) -> DataFrame:
    """Winners with the stored row they hit (``id``) and whether their price differs from the newest history row."""
    ids = current.select("id", *KEY)
    joined = (
        _store_ids(winners.drop("id"), supermarkets).join(ids, KEY, "left")
        .join(last, F.col("id") == F.col("supermarket_product_id"), "left"))

    def same(new: str, old: str) -> Column:
        return F.col(new).cast("decimal(18,2)").eqNullSafe(F.col(old).cast("decimal(18,2)"))

    first = F.col("supermarket_product_id").isNull()
    return joined.withColumns({
        "first_row": first, "changed": first | ~same("price", "last_price") | ~same("list_price", "last_list_price")})


def history_to_append(planned: DataFrame, now) -> DataFrame:
    """History rows of the changed winners, at two decimals, keyed like the current rows they belong to."""
    return planned.filter(F.col("changed") & (F.col("id").isNotNull() | is_ean(F.col("product_ean")))).select(
        F.coalesce("id", created_id(F.col("product_ean"), F.col("supermarket_id"))).alias("supermarket_product_id"),
        at(now).alias("scraped_at"), *KEY, F.col("price").cast("decimal(18,2)").alias("price"), F.col("list_price").cast("decimal(10,2)").alias("list_price"), "first_row")


def promote(evaluated: DataFrame) -> DataFrame:
    """An evaluated batch whose PENDING rows have been merged and are now PROMOTED; one pass, no join."""
    return evaluated.withColumn("status", F.when(F.col("status") == "PENDING", "PROMOTED").otherwise(F.col("status")))


def update_from_values(target: DataFrame, values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Set ``columns`` where the values table has a non-null value for the key."""
    new = values.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return target.join(new, key, "left").withColumns(
        {c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*target.columns)


def reconcile_summary(pending: DataFrame, products: DataFrame, planned: DataFrame) -> DataFrame:
    """One row of counts over the merge plans."""
    eans = pending.groupBy("ean").agg(F.count("*").alias("n"))
    seen = eans.join(products.select("ean", F.lit(1).alias("known")), "ean", "left").agg(
        F.sum("n").alias("promoted"), F.count("*").alias("distinct_eans"),
        F.count_if(F.col("known").isNull()).alias("new_products"), F.count("known").alias("merged_products"))
    rows = planned.agg(F.struct(
        F.count_if(F.col("id").isNull()).alias("created"), F.count("id").alias("updated"),
        F.count_if("changed").alias("history_inserted")).alias("r")).scalar()
    return seen.withColumn("_rows", rows).select(
        "promoted", "distinct_eans", "new_products", "merged_products", "_rows.created", "_rows.updated", "_rows.history_inserted")


def promoted_counts(pending: DataFrame) -> DataFrame:
    """Promoted rows by run and by source."""
    return (
        pending.groupBy(F.lit("run").alias("scope"), F.col("run_id").cast("string").alias("key")).agg(F.count("*").alias("promoted"))
        .unionByName(pending.groupBy(F.lit("source").alias("scope"), F.col("source_slug").alias("key")).agg(F.count("*").alias("promoted"))))


def legacy_persist(candidates: DataFrame, products: DataFrame, master: str) -> DataFrame:
    """Verdict of the older write path per candidate.

    The master store writes products in full; other stores skip EANs that are
    neither stored nor delivered by the master. Every persisted row adds history.
    """
    known = products.select("ean").unionByName(
        candidates.filter(F.col("source_slug") == master).select("ean")).distinct().withColumn("known", F.lit(True))
    return candidates.join(known, "ean", "left").withColumn(
        "outcome", F.when(F.col("known"), "persisted").otherwise("skipped")).drop("known")


def legacy_writes(candidates: DataFrame, products: DataFrame, master: str, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the older path writes: products of the master store in full, the last price per (EAN, store), and a
    history row for every persisted candidate, changed or not."""
    persisted = legacy_persist(candidates, products, master).filter(F.col("outcome") == "persisted").drop("outcome")
    fields = ["name", *FILL_COLUMNS, "images"]
    last = lambda cols: F.max_by(F.struct(*cols), F.col("id")).alias("c")
    own = persisted.filter(F.col("source_slug") == master).groupBy("ean").agg(last(fields)).select("ean", "c.*")
    prices = persisted.groupBy("ean", "source_slug").agg(last(PRICE_COLUMNS)).select(
        "ean", "source_slug", "c.*", at(now).alias("last_checked_at"))
    history = persisted.select("ean", "source_slug", "price", "list_price", at(now).alias("scraped_at"))
    return own, prices, history


def expire(rows: DataFrame, column: str, now, hours: int) -> DataFrame:
    """Rows young enough to stay; on a partitioned table this prunes old partitions."""
    return rows.filter(F.col(column) >= _cutoff(now, hours))


def expired_counts(rows: DataFrame, column: str, now, hours: int) -> DataFrame:
    """Dry run of the retention delete: deletable and kept rows."""
    old = F.col(column) < _cutoff(now, hours)
    return rows.agg(F.count_if(old).alias("deletable"), F.count_if(~old).alias("kept"))


def _cutoff(now, hours: int) -> Column:
    return F.timestamp_micros(F.unix_micros(at(now)) - F.lit(hours * 3_600_000_000))


def seed_dimension(stored: DataFrame, seed: DataFrame) -> DataFrame:
    """Upsert of stores by slug: name and address come from the seed, limit and activity stay."""
    new = seed.select("slug", F.col("name").alias("new_name"), F.col("base_url").alias("new_url"))
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    # a dimension of a few stores: numbering the new ones is one small task
    ids = seed.join(stored.select("slug"), "slug", "left_anti").select("slug", F.row_number().over(Window.orderBy("slug")).alias("_n"))
    return stored.join(new, "slug", "full_outer").join(ids, "slug", "left").withColumn("_last", last).select(
        F.coalesce("id", F.col("_last") + F.col("_n")).alias("id"), "slug", F.coalesce("new_name", "name").alias("name"), F.coalesce("new_url", "base_url").alias("base_url"),
        F.coalesce("is_active", F.lit(True)).alias("is_active"),
        F.coalesce("freshness_sla_hours", F.lit(12)).alias("freshness_sla_hours"))
