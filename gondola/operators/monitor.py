"""Operations: freshness limits, run and health panels, alerts, table state, promotions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import promo
from ..functions.freshness import at
from ..functions.numeric import half_up, one_decimal_percent, percent
from ..functions.text import clean, contains_ignore_case
from ..sources.stable import before, carried, ordered_chunks

# Fixed values.
TARGET_PERCENT, ALERT_PERCENT = 95.0, 80.0
QUALITY_BUCKETS = (("0-24", 0.0, 0.25), ("25-49", 0.25, 0.5), ("50-74", 0.5, 0.75), ("75-89", 0.75, 0.9), ("90-100", 0.9, None))


def _hours_before(now, hours: Column | int) -> Column:
    span = hours if isinstance(hours, Column) else F.lit(hours)
    return F.timestamp_micros(F.unix_micros(at(now)) - span.cast("bigint") * F.lit(3_600_000_000))


def _coalesced(*names: str) -> dict[str, Column]:
    return {n: F.coalesce(n, F.lit(0)) for n in names}


# -- runs ------------------------------------------------------------------------
def latest_good_runs(runs: DataFrame) -> DataFrame:
    """Newest SUCCESS or PARTIAL run per source, by end (or start) time."""
    at_time = F.coalesce("finished_at", "started_at")
    return (
        runs.filter(F.col("status").isin("SUCCESS", "PARTIAL")).groupBy("source_slug")
        .agg(F.max(F.struct(at_time.alias("latest_run_at"), F.col("id").alias("run_id"))).alias("r"))
        .select("source_slug", "r.run_id", "r.latest_run_at")
    )


def production_freshness(current: DataFrame, supermarkets: DataFrame, now) -> DataFrame:
    """Every active store with its rows, rows inside the limit and newest check."""
    stores = supermarkets.filter("is_active").select(
        F.col("id").alias("supermarket_id"), "name", "slug", F.col("freshness_sla_hours").alias("sla_hours"))
    counted = (
        current.join(stores.select("supermarket_id", "sla_hours"), "supermarket_id")
        .groupBy("supermarket_id")
        .agg(F.count("*").alias("total"),
             F.count_if(F.col("last_checked_at") >= _hours_before(now, F.col("sla_hours"))).alias("fresh"),
             F.max("last_checked_at").alias("latest_check_at"))
    )
    return stores.join(counted, "supermarket_id", "left").withColumns(_coalesced("total", "fresh"))


def shadow_freshness(supermarkets: DataFrame, runs: DataFrame, staging: DataFrame, now) -> DataFrame:
    """Distinct non-rejected EANs of the latest good run per active store."""
    stores = supermarkets.filter("is_active").select(
        F.col("id").alias("supermarket_id"), F.col("slug").alias("source_slug"), F.col("freshness_sla_hours").alias("sla_hours"))
    latest = stores.join(latest_good_runs(runs), "source_slug", "left")
    found = (
        staging.filter(F.col("status") != "REJECTED").select("run_id", "ean")
        .join(latest.select("run_id"), "run_id", "left_semi").groupBy("run_id").agg(F.count_distinct("ean").alias("total"))
    )
    inside = F.col("latest_run_at") >= _hours_before(now, F.col("sla_hours"))
    return latest.join(found, "run_id", "left").select(
        "supermarket_id", F.coalesce("total", F.lit(0)).alias("shadow_total"),
        F.when(inside, F.coalesce("total", F.lit(0))).otherwise(0).alias("shadow_fresh"), "latest_run_at")


def freshness_snapshot(production: DataFrame, shadow: DataFrame,
                       target: float = TARGET_PERCENT, alert: float = ALERT_PERCENT) -> DataFrame:
    """Per store: production figures, or those of a newer staged run."""
    use_shadow = (F.col("shadow_total") > 0) & (
        F.col("latest_check_at").isNull() | F.coalesce(F.col("latest_run_at") > F.col("latest_check_at"), F.lit(False)))

    def pick(shadow_col: str, production_col: str) -> Column:
        return F.when(use_shadow, F.col(shadow_col)).otherwise(F.col(production_col))

    rows = production.join(shadow, "supermarket_id", "left").withColumns(_coalesced("shadow_total", "shadow_fresh"))
    share = one_decimal_percent(F.col("fresh_rows"), F.col("total_rows"))
    return rows.select(
        "supermarket_id", "name", "slug", "sla_hours",
        pick("shadow_total", "total").alias("total_rows"), pick("shadow_fresh", "fresh").alias("fresh_rows"),
        pick("latest_run_at", "latest_check_at").alias("latest_check_at"),
        F.when(use_shadow, "shadow").otherwise("production").alias("basis"),
    ).withColumn("freshness_percent", share).withColumns({
        "below_target": F.col("freshness_percent") < target, "below_alert": F.col("freshness_percent") < alert})


def freshness_overall(snapshot: DataFrame) -> DataFrame:
    bases = F.collect_set(F.when(F.col("total_rows") > 0, F.col("basis")))
    return snapshot.agg(
        F.sum("total_rows").alias("total_rows"), F.sum("fresh_rows").alias("fresh_rows"),
        F.count_if("below_target").alias("sources_below_target"), F.count_if("below_alert").alias("sources_below_alert"),
        F.when(F.size(bases) == 0, "production").when(F.size(bases) > 1, "mixed").otherwise(F.get(bases, F.lit(0))).alias("mode"),
    ).withColumn("freshness_percent", one_decimal_percent(F.col("fresh_rows"), F.col("total_rows")))


# -- panels ----------------------------------------------------------------------
def _newest_per_source(log: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """Newest row per source of the whole log, with partial maxima of one row per source."""
    return log.groupBy("source_slug").agg(F.max_by(F.struct(*columns), F.struct(time, "id")).alias("r")).select(
        F.col("source_slug").alias("slug"), "r.*")


def run_panel(supermarkets: DataFrame, runs: DataFrame) -> DataFrame:
    latest = _newest_per_source(runs, "started_at", [
        "batch_id", "status", "started_at", "finished_at", "duration_ms", "products_staged", "products_promoted",
        "products_rejected"])
    counts = ("products_staged", "products_promoted", "products_rejected")
    rows = supermarkets.filter("is_active").select("name", "slug").join(latest, "slug", "left")
    return rows.withColumns({
        "status": F.coalesce("status", F.lit("NO_DATA")), **_coalesced(*counts)}).withColumn(
        "rejection_rate", one_decimal_percent(F.col("products_rejected"), F.col("products_staged")))


def health_state(is_healthy: Column, error_type: Column) -> Column:
    known = error_type.isin("blocked", "hash_invalid", "timeout", "network")
    return F.when(is_healthy.isNull(), "no_data").when(is_healthy, "healthy").when(known, error_type).otherwise("unknown")


def health_panel(supermarkets: DataFrame, health: DataFrame) -> DataFrame:
    latest = _newest_per_source(health, "checked_at", [
        "checked_at", "is_healthy", "hash_valid", "response_time_ms", "products_returned", "error_type"])
    rows = supermarkets.filter("is_active").select("name", "slug").join(latest, "slug", "left")
    return rows.withColumns({
        "state": health_state(F.col("is_healthy"), F.col("error_type")),
        "is_healthy": F.coalesce("is_healthy", F.lit(False)), "hash_valid": F.coalesce("hash_valid", F.lit(False)),
        "products_returned": F.coalesce("products_returned", F.lit(0))})


def quality_histogram(staging: DataFrame, now, days: int = 30) -> DataFrame:
    score = F.col("quality_score")
    recent = staging.filter(F.col("created_at") >= _hours_before(now, days * 24))
    counts = recent.agg(*[
        F.count_if((score >= low if low else F.lit(True)) & (score < high if high else F.lit(True))).alias(name)
        for name, low, high in QUALITY_BUCKETS])
    return counts.unpivot([], [name for name, _, _ in QUALITY_BUCKETS], "bucket", "rows")


def ingestion_trend(staging: DataFrame, runs: DataFrame, now, days: int = 30) -> DataFrame:
    """Detected EANs and run counters per day, with every day of the window present."""
    first = F.date_sub(F.to_date(at(now)), days - 1)
    detected = (
        staging.filter(F.col("created_at") >= first).groupBy(F.to_date("created_at").alias("day"))
        .agg(F.count_distinct("ean").alias("detected")))
    counted = (
        runs.filter(F.col("started_at") >= first).groupBy(F.to_date("started_at").alias("day"))
        .agg(F.sum("products_staged").alias("staged"), F.sum("products_promoted").alias("promoted"),
             F.sum("products_rejected").alias("rejected")))
    calendar = staging.sparkSession.range(1).select(F.explode(F.sequence(first, F.to_date(at(now)))).alias("day"))
    return calendar.join(detected, "day", "left").join(counted, "day", "left").withColumns(
        _coalesced("detected", "staged", "promoted", "rejected"))


def admin_overview(supermarkets: DataFrame, runs: DataFrame, health: DataFrame, current: DataFrame, staging: DataFrame,
                   now, stage_now, days: int = 30) -> DataFrame:
    """One row over all stores: newest run, failed, healthy and blocked sources, freshness, counters of the last days, quality.

    Every input is reduced to a row per source in one pass; the staged rows meet their source's newest good run on the way,
    for which the runs are read a second time. ``now`` is the clock of the prices, ``stage_now`` that of the runs.
    """
    first, today = F.date_sub(F.to_date(at(stage_now)), days - 1), F.to_date(at(stage_now))
    ended = F.coalesce("finished_at", "started_at")
    good = F.col("status").isin("SUCCESS", "PARTIAL")
    inside = F.to_date("started_at").between(first, today)
    of_runs = runs.groupBy(F.col("source_slug").alias("slug")).agg(
        F.max_by(F.struct("started_at", "status"), F.struct("started_at", "id")).alias("last"),
        F.max(F.when(good, F.struct(ended.alias("latest_run_at"), F.col("id").alias("run_id")))).alias("good"),
        F.sum(F.when(inside, F.col("products_promoted"))).alias("promoted"),
        F.sum(F.when(inside, F.col("products_rejected"))).alias("rejected"))
    of_health = health.groupBy(F.col("source_slug").alias("slug")).agg(
        F.max_by(F.struct("is_healthy", "error_type"), F.struct("checked_at", "id")).alias("probe"))
    newest = latest_good_runs(runs).select("run_id", F.col("source_slug").alias("slug"))
    recent = F.col("created_at") >= _hours_before(stage_now, days * 24)
    of_staging = staging.select("run_id", "ean", "status", "quality_score", "created_at").join(newest, "run_id", "left").groupBy("slug").agg(
        F.count_distinct(F.when(F.col("slug").isNotNull() & (F.col("status") != "REJECTED"), F.col("ean"))).alias("shadow"),
        F.sum(F.when(recent, F.col("quality_score"))).alias("_score"), F.count_if(recent).alias("_scored")).withColumn(
        "slug", F.coalesce("slug", F.lit("")))  # rows of no newest run, for their quality
    of_prices = production_freshness(current, supermarkets, now).withColumn("_active", F.lit(True))
    # a few sources from here on; those without an active store count for the sums only
    rows = of_prices.join(of_runs, "slug", "full_outer").join(of_health, "slug", "left").join(of_staging, "slug", "full_outer")
    use_shadow = (F.col("shadow") > 0) & (F.col("latest_check_at").isNull() | F.coalesce(F.col("good.latest_run_at") > F.col("latest_check_at"), F.lit(False)))
    in_time = F.col("good.latest_run_at") >= _hours_before(now, F.col("sla_hours"))
    shadow_fresh = F.when(in_time, F.col("shadow")).otherwise(0)
    rows = rows.withColumns({
        "_total": F.when(use_shadow, F.col("shadow")).otherwise(F.col("total")),
        "_fresh": F.when(use_shadow, shadow_fresh).otherwise(F.col("fresh")),
        "_state": health_state(F.col("probe.is_healthy"), F.col("probe.error_type"))})
    active, share = F.col("_active"), one_decimal_percent(F.col("_fresh"), F.col("_total"))
    quality = half_up(F.coalesce(F.try_divide(F.sum("_score"), F.sum("_scored")), F.lit(0.0)) * 100.0, 1)
    return rows.agg(
        quality.alias("average_quality"),
        F.max(F.when(active, F.col("last.started_at"))).alias("latest_run_at"),
        F.count_if(active & (F.col("last.status") == "FAILED")).alias("failed_sources"),
        F.count_if(active & (F.col("_state") == "healthy")).alias("healthy_sources"),
        F.count_if(active & (F.col("_state") == "blocked")).alias("blocked_sources"),
        F.sum(F.when(active, F.col("_fresh"))).alias("_fresh"), F.sum(F.when(active, F.col("_total"))).alias("_total"),
        F.count_if(active & (share < ALERT_PERCENT)).alias("sources_below_sla"),
        F.coalesce(F.sum("promoted"), F.lit(0)).alias("promoted"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"),
    ).select("latest_run_at", "failed_sources", "healthy_sources", "blocked_sources",
             one_decimal_percent(F.col("_fresh"), F.col("_total")).alias("freshness_percent"), "sources_below_sla", "promoted", "rejected",
             "average_quality")


def scraper_stats(supermarkets: DataFrame, current: DataFrame, now, hours: int = 24) -> DataFrame:
    since = _hours_before(now, hours)
    recent = F.col("last_checked_at") >= since
    counted = current.groupBy(F.col("supermarket_id").alias("id")).agg(
        F.count_if(recent).alias("updated"), F.count_if(~recent).alias("stale"),
        F.max(F.when(recent, F.col("last_checked_at"))).alias("latest_check_at"))
    return supermarkets.select("id", "name", "slug").join(counted, "id", "left").withColumns(_coalesced("updated", "stale"))


def scraper_overview(stats: DataFrame, current: DataFrame, history: DataFrame, now, hours: int = 24) -> DataFrame:
    since = _hours_before(now, hours)
    return stats.agg(
        F.sum("updated").alias("updated"), F.count_if(F.col("updated") > 0).alias("active_stores"),
        F.sum("stale").alias("stale")).select(
        "updated", "active_stores", "stale",
        history.filter(F.col("scraped_at") >= since).agg(F.count("*")).scalar().alias("history_records"),
        current.agg(F.max("last_checked_at")).scalar().alias("latest_run_at"))


# -- alerts ----------------------------------------------------------------------
def ingest_alerts(snapshot: DataFrame, source_rows: DataFrame, max_rejected_share: float = 0.1) -> DataFrame:
    """(alert, source) rows: freshness, blocked sources, quality loss, stale query hash everywhere."""
    hash_bad = ~F.col("is_healthy") & (F.col("error_type") == "hash_invalid")
    everywhere = source_rows.agg(F.bool_and(F.coalesce(hash_bad, F.lit(False)))).scalar()
    rejected = (F.col("staged") > 0) & (F.col("rejected") / F.col("staged") > max_rejected_share)
    checks = F.filter(F.array(
        F.when(F.col("_everywhere"), F.lit("hash_invalid_all_sources")),
        F.when(F.col("error_type") == "blocked", F.lit("blocked_sources")),
        F.when(rejected, F.lit("quality_degradation"))), lambda a: a.isNotNull())
    rows = source_rows.withColumn("_everywhere", everywhere)
    return rows.select(F.explode(checks).alias("alert"), "slug").unionByName(
        snapshot.filter("below_alert").select(F.lit("freshness_sla_violation").alias("alert"), "slug"))


def failure_streaks(log: DataFrame, initial: DataFrame | None = None, source: str = "source_slug",
                    time: str = "checked_at", ok: str = "is_healthy") -> DataFrame:
    """Length of the run of consecutive failures at every row; 0 on success.

    A running count over contiguous chunks plus the count carried in from earlier
    chunks of the same source, so no task ever holds one source's whole log.
    ``initial`` gives the failures (source, initial) counted before this log.
    """
    chunks = ordered_chunks(log.select("id", source, time, ok), time)
    inside = Window.partitionBy(source, "chunk").orderBy(time, "id")
    group = chunks.withColumn("_good", F.sum(F.col(ok).cast("int")).over(inside))
    in_group = Window.partitionBy(source, "chunk", "_good").orderBy(time, "id")
    local = group.withColumn("_streak", F.sum((~F.col(ok)).cast("bigint")).over(in_group))
    # Failures after the last success of each chunk; a chunk without success adds to what came
    # before. With prefix sums S of those tails, the carry is S minus the S of the last chunk
    # holding a success (S never falls, so that is the largest one).
    tail = carried(local, [source], {
        "_any": F.max(F.col(ok)), "_tail": F.max_by("_streak", F.struct(time, "id"))})
    earlier = before([source])
    sums = tail.withColumn("_sum", F.coalesce(F.sum("_tail").over(earlier), F.lit(0)))
    carry = sums.withColumn("_reset", F.max(F.when(F.col("_any"), F.col("_sum"))).over(earlier))
    start = F.lit(0)
    if initial is not None:
        carry = carry.join(initial.select(source, "initial"), source, "left")
        start = F.when(F.col("_reset").isNull(), F.coalesce("initial", F.lit(0))).otherwise(0)
    carry = carry.select(source, "chunk", (F.col("_sum") - F.coalesce("_reset", F.lit(0)) + start).alias("_carry"))
    add = F.when((F.col("_good") == 0) & ~F.col(ok), F.col("_carry")).otherwise(F.lit(0))
    return local.join(carry, [source, "chunk"]).select("id", source, time, ok, (F.col("_streak") + add).alias("failures"))


def stuck_work(runs: DataFrame, staging: DataFrame, now, run_minutes: int = 60, pending_minutes: int = 60) -> DataFrame:
    """Running runs and pending rows older than their limits, as checks."""
    run_cut = F.timestamp_micros(F.unix_micros(at(now)) - F.lit(run_minutes * 60_000_000))
    row_cut = F.timestamp_micros(F.unix_micros(at(now)) - F.lit(pending_minutes * 60_000_000))
    stuck = runs.filter((F.col("status") == "RUNNING") & (F.col("started_at") < run_cut)).agg(F.count("*").alias("rows"))
    old = staging.filter((F.col("status") == "PENDING") & (F.col("created_at") < row_cut)).agg(F.count("*").alias("rows"))
    return stuck.select(F.lit("stuck_running_runs").alias("check"), "rows").unionByName(
        old.select(F.lit("old_pending_rows").alias("check"), "rows")).withColumn(
        "status", F.when(F.col("rows") > 0, "WARN").otherwise("PASS"))


# -- table state -----------------------------------------------------------------
def staging_state(staging: DataFrame, now) -> DataFrame:
    s = F.col("status")
    return staging.agg(
        F.count("*").alias("total"), *[F.count_if(s == v.upper()).alias(v) for v in ("pending", "promoted", "rejected")],
        F.count_if(F.col("created_at") < _hours_before(now, 48)).alias("stale_48h"), F.count_distinct("run_id").alias("runs"))


def product_stats(products: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return products.agg(
        F.count("*").alias("total"), distinct("category").alias("categories"), distinct("brand").alias("brands"),
        F.count("image_url").alias("with_image"))


def store_coverage(current: DataFrame, supermarkets: DataFrame) -> DataFrame:
    counted = current.groupBy(F.col("supermarket_id").alias("id")).agg(F.count("*").alias("rows"))
    total = current.agg(F.count("*").alias("n")).scalar()
    return supermarkets.select("id", "name").join(counted, "id").withColumn("share", percent(F.col("rows"), total))


def history_growth(history: DataFrame) -> DataFrame:
    return history.agg(
        F.count("*").alias("rows"), F.count_distinct("supermarket_product_id").alias("keys"),
        F.min("scraped_at").alias("oldest"), F.max("scraped_at").alias("newest"))


def run_history(runs: DataFrame, rows: int = 20) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(rows)


# -- promotions ------------------------------------------------------------------
def admin_promotions(promotions: DataFrame, bridge: DataFrame, now, status: str | None = None, kind: str | None = None,
                     supermarket_id: int | None = None, query: str | None = None) -> DataFrame:
    """Filtered listing with sorted EANs; here expired does not look at the active flag."""
    t, rows = at(now), promotions
    rules = {
        "active": promo.running(F.col("is_active"), F.col("start_date"), F.col("end_date"), now),
        "scheduled": F.col("is_active") & (F.col("start_date") > t), "expired": F.col("end_date") < t,
        "inactive": ~F.col("is_active")}
    if status is not None:
        rows = rows.filter(rules[status])
    if kind is not None:
        rows = rows.filter(F.col("type") == kind)
    if supermarket_id is not None:
        rows = rows.filter(F.col("supermarket_id") == supermarket_id)
    if query is not None:
        hits = [F.coalesce(contains_ignore_case(F.col(c), query), F.lit(False))
                for c in ("title", "wallet_provider", "bank_name", "conditions")]
        rows = rows.filter(hits[0] | hits[1] | hits[2] | hits[3])
    # a promotion lists at most 200 EANs: apply_promotions, its writer, refuses more
    listed = bridge.join(rows.select(F.col("id").alias("promotion_id")), "promotion_id", "left_semi").groupBy(
        F.col("promotion_id").alias("id")).agg(F.sort_array(F.collect_list("product_ean")).alias("eans"))
    return rows.join(listed, "id", "left").withColumns({
        "eans": F.coalesce("eans", F.expr("array()")),
        "lifecycle": promo.lifecycle(F.col("is_active"), F.col("start_date"), F.col("end_date"), now),
    })


def promotion_stats(promotions: DataFrame, now) -> DataFrame:
    t = at(now)
    return promotions.agg(
        F.count("*").alias("total"), F.count_if("is_active").alias("active"),
        F.count_if(F.col("start_date") > t).alias("scheduled"), F.count_if(F.col("end_date") < t).alias("expired"))


def validate_promotions(feed: DataFrame, listed: DataFrame, supermarkets: DataFrame, products: DataFrame, max_eans: int = 200) -> DataFrame:
    """Reasons why a promotion upsert is refused; an empty list means it is accepted."""
    eans = listed.distinct()
    unknown = eans.join(products.select(F.col("ean").alias("product_ean")), "product_ean", "left_anti").groupBy(
        F.col("promotion_id").alias("id")).agg(F.count("*").alias("_unknown"))
    sizes = listed.groupBy(F.col("promotion_id").alias("id")).agg(F.count("*").alias("_eans"))
    stores = supermarkets.select(F.col("id").alias("supermarket_id"), F.lit(True).alias("_store"))
    length = F.length(F.coalesce(clean(F.col("title")), F.lit("")))
    checks = [
        ("title_length", (length < 3) | (length > 160)),
        ("wallet_provider_missing", (F.col("type") == "wallet_discount") & clean(F.col("wallet_provider")).isNull()),
        ("bank_name_missing", (F.col("type") == "bank_discount") & clean(F.col("bank_name")).isNull()),
        ("end_before_start", F.col("end_date") < F.col("start_date")),
        ("too_many_products", F.col("_eans") > max_eans),
        ("unknown_store", F.col("_store").isNull()),
        ("unknown_product", F.col("_unknown") > 0)]
    reasons = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]), lambda r: r.isNotNull())
    return feed.join(unknown, "id", "left").join(sizes, "id", "left").join(stores, "supermarket_id", "left").select(
        "id", reasons.alias("reasons"))


PROMOTION_FIELDS = ["supermarket_id", "type", "title", "wallet_provider", "bank_name", "discount_value", "conditions",
                    "start_date", "end_date", "is_active"]


def _numbered(keys: DataFrame, key: str) -> DataFrame:
    """(key, n): numbers from 1 in the order of the key's MD5, without one task that orders all keys."""
    digest = F.md5(F.col(key).cast("string"))
    rows = keys.select(key).distinct().withColumns({"_md5": digest, "_part": F.substring(digest, 1, 3)})
    parts = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    # at most 4096 parts
    ahead = parts.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_ahead"))
    inside = Window.partitionBy("_part").orderBy("_md5", key)
    return rows.withColumn("_n", F.row_number().over(inside)).join(ahead, "_part").select(key, (F.col("_ahead") + F.col("_n")).alias("n"))


def promotion_verdicts(feed: DataFrame, listed: DataFrame, promotions: DataFrame, supermarkets: DataFrame, products: DataFrame) -> DataFrame:
    """(feed_key, id, reasons): the checks of an upsert, and ``not_found`` for an update of an id that is not stored."""
    keyed = feed.withColumnRenamed("id", "_target").withColumn("id", F.col("feed_key"))
    checked = validate_promotions(keyed, listed.withColumnRenamed("feed_key", "promotion_id"), supermarkets, products).select(
        F.col("id").alias("feed_key"), "reasons")
    stored = promotions.select("id", F.lit(True).alias("_stored"))
    found = feed.select("feed_key", "id").join(stored, "id", "left")
    lost = F.when(F.col("id").isNotNull() & F.col("_stored").isNull(), F.array(F.lit("not_found"))).otherwise(F.expr("array()"))
    return found.join(checked, "feed_key").select("feed_key", "id", F.concat("reasons", lost).alias("reasons"))


def apply_promotions(promotions: DataFrame, bridge: DataFrame, feed: DataFrame, listed: DataFrame, supermarkets: DataFrame,
                     products: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Promotions and their product lists after a feed, and the verdicts on its rows.

    feed: feed_key, id (null creates a promotion) and the promotion's fields; listed: feed_key, product_ean, blank
    ones left out and repeated ones taken once. An accepted row replaces all fields and, by parent key, the whole list
    of its promotion; a refused one changes nothing. A feed has at most one row per id: of several the largest feed_key counts.
    """
    eans = listed.select("feed_key", clean(F.col("product_ean")).alias("product_ean")).filter("product_ean IS NOT NULL").distinct()
    verdicts = promotion_verdicts(feed, eans, promotions, supermarkets, products)
    accepted = feed.join(verdicts.filter(F.size("reasons") == 0).select("feed_key"), "feed_key", "left_semi")
    updates = accepted.filter("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("feed_key", *PROMOTION_FIELDS), "feed_key").alias("new"))
    creates = accepted.filter("id IS NULL").withColumnRenamed("id", "_none")
    last = promotions.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    made = creates.join(_numbered(creates, "feed_key"), "feed_key").withColumn("_last", last).select(
        (F.col("_last") + F.col("n")).alias("id"), "feed_key", *PROMOTION_FIELDS)
    text = {"title": clean(F.col("title"))}
    kinds = promotions.schema
    stored = promotions.join(updates, "id", "left").select("id", *[
        F.when(F.col("new").isNotNull(), F.col(f"new.{c}").cast(kinds[c].dataType)).otherwise(F.col(c)).alias(c) for c in PROMOTION_FIELDS],
        F.col("new.feed_key").alias("_key"))
    new_rows = made.select("id", *[F.col(c).cast(kinds[c].dataType).alias(c) for c in PROMOTION_FIELDS], F.col("feed_key").alias("_key"))
    after = stored.unionByName(new_rows)
    written = updates.select("id", "new.feed_key").unionByName(made.select("id", "feed_key"))
    lists = bridge.join(written.select(F.col("id").alias("promotion_id")), "promotion_id", "left_anti").select("promotion_id", "product_ean").unionByName(
        eans.join(written, "feed_key").select(F.col("id").alias("promotion_id"), "product_ean"))
    final = after.withColumn("title", F.when(F.col("_key").isNotNull(), text["title"]).otherwise(F.col("title"))).drop("_key")
    return final, lists, verdicts
