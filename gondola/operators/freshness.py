"""Freshness audits over existing rows.

Input rows: id, ean, product_name, source_slug, price, is_available,
last_checked_at and the store's freshness_sla_hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import freshness as fr
from ..functions.numeric import percent, positive
from ..functions.quality import has_text
from ..functions.rules import reasons, verdict_of

EXCLUSIONS = ("unavailable", "missing_price", "invalid_price", "missing_name", "missing_ean")
BUCKETS = ("within_sla", "up_to_7d", "up_to_30d", "over_30d", "unknown")
# Freshness targets and batch sizes of the refresh planning.
TARGETS = (("recovery", 90), ("final", 95))
BATCH_SIZES = (10, 25, 50)
# Shrink of the rankable rows that blocks a baseline.
MAX_SHRINK_PERCENT, MAX_SHRINK_ROWS = 1.0, 10


def exclusion_reasons() -> Column:
    """Why a row may not be ranked publicly; all reasons that apply."""
    price = F.col("price")
    return reasons([
        ("unavailable", ~F.coalesce("is_available", F.lit(False))), ("missing_price", price.isNull()),
        ("invalid_price", price.isNotNull() & ~positive(price)),
        ("missing_name", ~has_text(F.col("product_name"))), ("missing_ean", ~has_text(F.col("ean")))])


def is_rankable() -> Column:
    return (F.coalesce("is_available", F.lit(False)) & positive(F.col("price"))
            & has_text(F.col("product_name")) & has_text(F.col("ean")))


def classified(rows: DataFrame, now) -> DataFrame:
    at, sla = F.col("last_checked_at"), F.col("freshness_sla_hours")
    return rows.withColumns({
        "status": fr.freshness(at, sla, now), "bucket": fr.age_bucket(at, sla, now),
        "rankable": is_rankable(), "excluded_for": exclusion_reasons()})


def freshness_baseline(rows: DataFrame, now) -> DataFrame:
    """Per source counts over all rows, exclusion reasons and age buckets; the last row is the total."""
    s = F.col("status")
    counts = {
        "total_rows": F.count("*"), "fresh_rows": F.count_if(s == fr.FRESH), "stale_rows": F.count_if(s == fr.STALE),
        "unknown_rows": F.count_if(s == fr.UNKNOWN), "unavailable_rows": F.count_if(~F.col("is_available")),
        "rankable_rows": F.count_if("rankable"), "excluded_rows": F.count_if(~F.col("rankable")),
        **{f"excluded_{r}": F.count_if(F.array_contains("excluded_for", r)) for r in EXCLUSIONS},
        **{f"age_{b}": F.count_if(F.col("bucket") == b) for b in BUCKETS}}
    per_source = classified(rows, now).groupBy("source_slug").agg(
        *[c.alias(n) for n, c in counts.items()],
        F.min("last_checked_at").alias("oldest_check_at"), F.max("last_checked_at").alias("latest_check_at"))
    total = per_source.agg(  # one row per source goes in
        F.lit("all").alias("source_slug"), *[F.sum(n).alias(n) for n in counts],
        F.min("oldest_check_at").alias("oldest_check_at"), F.max("latest_check_at").alias("latest_check_at"))
    return per_source.unionByName(total).withColumn(
        "freshness_percent", percent(F.col("fresh_rows"), F.col("total_rows")))


def ean_overlap(rows: DataFrame, top: int = 10, collation: str | None = "es") -> DataFrame:
    """EANs by the number of sources selling them; the name is the one of the first row."""
    ean = F.trim("ean")
    grouped = rows.filter(has_text(F.col("ean"))).groupBy(ean.alias("ean")).agg(
        F.min_by(F.coalesce("product_name", F.lit("")), F.col("id")).alias("name"),
        F.sort_array(F.collect_set("source_slug")).alias("sources"))
    name = F.collate("name", collation) if collation else F.col("name")
    return grouped.withColumn("source_count", F.size("sources").cast("bigint")).orderBy(
        F.desc("source_count"), name, "ean").limit(top)


def stale_examples(rows: DataFrame, now, top: int = 10) -> DataFrame:
    """Cheapest stale rows that are still ranked publicly."""
    return classified(rows, now).filter((F.col("status") == fr.STALE) & F.col("rankable")).orderBy(
        "price", "id").limit(top).select("id", "ean", "source_slug", F.col("price").cast("double").alias("price"))


def oldest_samples(rows: DataFrame, top: int = 10) -> DataFrame:
    """Least recently checked rows per source, unchecked rows last (cut per partition before the shuffle)."""
    order = Window.partitionBy("source_slug").orderBy(F.col("last_checked_at").asc_nulls_last(), "id")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top).select(
        "source_slug", F.col("position").cast("bigint").alias("position"), "id", "last_checked_at")


def oldest_rankable(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("source_slug").orderBy("last_checked_at", "id")
    return rows.filter(is_rankable()).withColumn("scan_ord", F.row_number().over(order)).filter(F.col("scan_ord") <= top)


def denominator_deltas(current: DataFrame, previous: DataFrame, explanations: DataFrame,
                       max_percent: float = MAX_SHRINK_PERCENT, max_rows: int = MAX_SHRINK_ROWS) -> DataFrame:
    """Shrink of the rankable rows per source and overall against the previous snapshot.

    Inputs have (slug, rows); explanations name approved slugs, ``all`` for the total.
    """
    def with_total(df: DataFrame, name: str) -> DataFrame:
        return df.select("slug", F.col("rows").alias(name)).unionByName(
            df.agg(F.lit("all").alias("slug"), F.sum("rows").alias(name)))

    joined = with_total(current, "current_rows").join(with_total(previous, "previous_rows"), "slug", "full_outer")
    shrink = F.greatest(F.lit(0), F.col("previous_rows") - F.col("current_rows"))
    share = F.when(F.col("previous_rows") > 0, F.col("shrink_rows") / F.col("previous_rows") * 100.0).otherwise(0.0)
    explained = explanations.select("slug").distinct().withColumn("explained", F.lit(True))
    over = (F.col("shrink_rows") > 0) & ((F.col("shrink_rows") > max_rows) | (F.col("raw_share") > max_percent))
    return (
        joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("current_rows", "previous_rows")})
        .withColumn("shrink_rows", shrink).withColumn("raw_share", share).join(explained, "slug", "left")
        .select("slug", "current_rows", "previous_rows", "shrink_rows",
                percent(F.col("shrink_rows"), F.col("previous_rows")).alias("shrink_percent"),
                (over & F.col("explained").isNull()).alias("blocked"))
    )


def baseline_status(rows: DataFrame, now, explained: list[str], runs: DataFrame, staging: DataFrame,
                    target: float = 95.0, fail_under: float | None = None) -> DataFrame:
    """One overall status row of the freshness baseline.

    FAIL where the rankable rows of a source or of all shrank beyond the limits of ``denominator_deltas`` without an
    explanation (slugs, ``all`` for the total) or freshness is under ``fail_under``; WARN with runs or staged rows still
    open, or below the target. The rows are read once: measures per source first, then one row over the sources.
    """
    ranked = classified(rows, now)
    per = ranked.groupBy("source_slug").agg(
        F.count("*").alias("total_rows"), F.count_if(F.col("status") == fr.FRESH).alias("fresh_rows"),
        F.count_if("rankable").alias("rankable_rows"), F.count_if("is_available").alias("_previous"))

    def blocked(current: Column, previous: Column) -> Column:
        shrink = F.greatest(F.lit(0), previous - current)
        return (shrink > 0) & ((shrink > MAX_SHRINK_ROWS) | (shrink / previous * 100.0 > MAX_SHRINK_PERCENT))

    unexplained = blocked(F.col("rankable_rows"), F.col("_previous")) & ~F.col("source_slug").isin(*explained)
    overall = per.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_rows", "fresh_rows", "rankable_rows", "_previous")],
        F.coalesce(F.bool_or(unexplained), F.lit(False)).alias("_blocked"))
    total_blocked = F.lit("all" not in explained) & blocked(F.col("rankable_rows"), F.col("_previous"))
    running = runs.agg(F.count_if(F.col("status") == "RUNNING")).scalar()
    pending = staging.agg(F.count_if(F.col("status") == "PENDING")).scalar()
    share = F.col("freshness_percent")
    too_low = share < fail_under if fail_under is not None else F.lit(False)
    work_open = (F.col("running_runs") > 0) | (F.col("pending_rows") > 0)
    return overall.withColumns({
        "running_runs": running, "pending_rows": pending, "freshness_percent": percent(F.col("fresh_rows"), F.col("total_rows"))}).select(
        "total_rows", "fresh_rows", "freshness_percent", "rankable_rows", "running_runs", "pending_rows",
        verdict_of(F.col("_blocked") | total_blocked | too_low, work_open | (share < target)).alias("status"))


def source_health(rows: DataFrame, now, target: float = 95.0, fail_under: float | None = None) -> DataFrame:
    """Freshness over rankable rows only."""
    ranked = classified(rows, now).filter("rankable")
    out = ranked.groupBy("source_slug").agg(
        F.count("*").alias("rankable_rows"), F.count_if(F.col("status") == fr.FRESH).alias("fresh_rows"),
        F.count_if(F.col("last_checked_at").isNull()).alias("unknown_rows"),
        F.min("last_checked_at").alias("oldest_check_at"), F.max("last_checked_at").alias("latest_check_at"))
    total = rows.groupBy("source_slug").agg(F.count("*").alias("total_rows"))
    share = F.col("freshness_percent")
    fails = (F.col("rankable_rows") == 0) | (share < fail_under if fail_under is not None else F.lit(False))
    return (
        total.join(out, "source_slug", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rankable_rows", "fresh_rows", "unknown_rows")})
        .withColumn("stale_rows", F.col("rankable_rows") - F.col("fresh_rows") - F.col("unknown_rows"))
        .withColumn("freshness_percent", percent(F.col("fresh_rows"), F.col("rankable_rows")))
        .withColumn("status", verdict_of(fails, share < target))
    )


def freshness_debt(health: DataFrame, max_runs: dict[str, int], sizes: tuple[int, ...] = BATCH_SIZES) -> DataFrame:
    """Rows and batches missing per source, target and batch size, and whether the runs of a window suffice."""
    target = F.explode(F.array(*[
        F.struct(F.lit(n).alias("target"), F.lit(p).alias("target_percent"), F.lit(max_runs[n]).alias("max_runs"))
        for n, p in TARGETS]))
    needed = F.greatest(F.lit(0), F.ceil(
        F.col("rankable_rows") * F.col("t.target_percent") / F.lit(100.0)) - F.col("fresh_rows")).cast("bigint")
    return (
        health.select("source_slug", "rankable_rows", "fresh_rows", target.alias("t"))
        .select("source_slug", "t.*", needed.alias("rows_needed"), F.explode(F.array(*[F.lit(s) for s in sizes])).alias("batch_size"))
        .withColumn("batches", F.ceil(F.col("rows_needed") / F.col("batch_size")).cast("bigint"))
        .withColumn("fits_window", F.col("batches") <= F.col("max_runs"))
    )


def debt_totals(debt: DataFrame) -> DataFrame:
    return debt.groupBy("target", "batch_size").agg(
        F.sum("rows_needed").alias("rows_needed"), F.sum("batches").alias("batches"),
        F.bool_and("fits_window").alias("every_source_fits"))


def throughput(health: DataFrame, rows_per_chunk: int, chunks_per_run: int, cadence_hours: float, sla_hours: float,
               skip_runs: int = 0, target: float = 95.0) -> DataFrame:
    """Rows a refresh schedule covers within the limit against the rows required, per source."""
    if target < 95 or min(rows_per_chunk, chunks_per_run, cadence_hours, sla_hours) <= 0:
        raise ValueError("target must be at least 95 and the schedule positive")
    runs = max(0, int(sla_hours // cadence_hours) - skip_runs)
    covered = rows_per_chunk * chunks_per_run * runs
    return health.filter(F.col("rankable_rows") > 0).select(
        "source_slug", "rankable_rows", F.lit(runs).cast("bigint").alias("runs"), F.lit(covered).cast("bigint").alias("coverable_rows"),
        F.ceil(F.col("rankable_rows") * F.lit(target / 100.0)).cast("bigint").alias("required_rows"),
        percent(F.lit(covered).cast("bigint"), F.col("rankable_rows")).alias("coverage_percent"),
    ).withColumn("status", F.when(F.col("coverable_rows") < F.col("required_rows"), "FAIL").otherwise("PASS"))
