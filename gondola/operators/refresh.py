"""Refresh of existing rows from live lookups: guards, capacity, selection, application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.freshness import at
from ..functions.numeric import absolute_delta_percent, drift_percent, percent, positive
from ..functions.quality import has_text
from ..functions.rules import reasons, verdict_of
from ..functions.text import has_broken_text
from ..functions.web import url_host


# -- lookups -----------------------------------------------------------------------
def sku_uniqueness(rows: DataFrame) -> DataFrame:
    """Rows with the number of rows of their source that carry the same SKU."""
    counts = rows.filter(has_text(F.col("sku_id"))).groupBy("source_slug", "sku_id").agg(F.count("*").alias("sku_rows"))
    return rows.join(counts, ["source_slug", "sku_id"], "left").withColumn("sku_rows", F.coalesce("sku_rows", F.lit(0)))


def live_by_sku(live: DataFrame) -> DataFrame:
    """Live products per (source, SKU): how many, and the product when it is the only one."""
    one = F.struct(F.col("ean"), F.col("sku_id").alias("sku"), F.col("product_url").alias("url"),
                   "price", "list_price", "is_available")
    return live.filter(has_text(F.col("sku_id"))).groupBy("source_slug", "sku_id").agg(
        F.count("*").alias("n"), F.min(one).alias("p")).select(
        "source_slug", "sku_id", F.col("n").alias("live_count"), F.when(F.col("n") == 1, F.col("p")).alias("live"))


def with_live(rows: DataFrame, live: DataFrame) -> DataFrame:
    return rows.join(live_by_sku(live), ["source_slug", "sku_id"], "left").withColumn(
        "live_count", F.coalesce("live_count", F.lit(0)))


def guard_reasons(variant: str, expected_host: Column, max_delta_percent: float = 200.0) -> Column:
    """Reasons against refreshing a row; ``variant`` is prewrite, capacity or manifest."""
    if variant not in ("prewrite", "capacity", "manifest"):
        raise ValueError(f"unknown guard variant {variant}")
    has_sku = has_text(F.col("sku_id"))
    single = F.col("live_count") == 1
    live_host, own_host = url_host(F.col("live.url")), url_host(F.col("product_url"))
    delta = absolute_delta_percent(F.col("price"), F.col("live.price"))
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    checks = [
        ("no_product_snapshot", F.col("product_name").isNull()),
        ("no_ean", ~has_text(F.col("ean"))),
        ("no_sku", ~has_sku),
        ("sku_not_unique", has_sku & (F.col("sku_rows") != 1)),
        ("live_match_not_single", has_sku & ~single),
        ("ean_mismatch", single & ~same("live.ean", "ean")),
        ("sku_mismatch", single & ~same("live.sku", "sku_id")),
        ("unexpected_host", single & ~F.coalesce(live_host == expected_host, F.lit(False))),
        ("host_drift", own_host != live_host),
        ("live_unavailable", single & ~F.coalesce("live.is_available", F.lit(False))),
        ("live_price_not_positive", single & ~positive(F.col("live.price"))),
        ("price_delta_too_large", delta > max_delta_percent),
    ]
    dropped = {
        "prewrite": {"live_unavailable"}, "capacity": set(),
        "manifest": {"no_product_snapshot", "live_unavailable", "live_price_not_positive", "price_delta_too_large"}}
    return reasons([c for c in checks if c[0] not in dropped[variant]])


def evaluate_rows(rows: DataFrame, universe: DataFrame, live: DataFrame, hosts: DataFrame, variant: str) -> DataFrame:
    """Rows with their guard reasons; SKU uniqueness is judged over the whole ``universe``."""
    counts = universe.filter(has_text(F.col("sku_id"))).groupBy("source_slug", "sku_id").agg(F.count("*").alias("sku_rows"))
    joined = with_live(rows, live).join(counts, ["source_slug", "sku_id"], "left").join(hosts, "source_slug", "left")
    return joined.withColumn("reasons", guard_reasons(variant, F.col("expected_host"))).withColumn(
        "status", F.when(F.size("reasons") == 0, "PASS").otherwise("FAIL"))


def blocker_histogram(evaluated: DataFrame, *keys: str) -> DataFrame:
    return evaluated.select(*keys, F.explode("reasons").alias("reason")).groupBy(*keys, "reason").agg(F.count("*").alias("rows"))


# -- capacity ------------------------------------------------------------------------
def refresh_capacity(health: DataFrame, evaluated: DataFrame, writers: list[str], target_batch: int,
                     targets: tuple[int, ...] = (90, 95)) -> DataFrame:
    """Per source: viable share of the scanned rows and what it means for batches.

    ``health`` has rankable and fresh rows per source, ``evaluated`` the scanned rows.
    """
    scanned = evaluated.groupBy("source_slug").agg(
        F.count("*").alias("evaluated_rows"), F.count_if(F.col("status") == "PASS").alias("viable_rows"))
    viable, n = F.col("viable_rows"), F.col("evaluated_rows")
    rows = health.select("source_slug", "rankable_rows", "fresh_rows").join(scanned, "source_slug", "left").withColumns({
        "evaluated_rows": F.coalesce("evaluated_rows", F.lit(0)), "viable_rows": F.coalesce("viable_rows", F.lit(0)),
        "writer_supported": F.col("source_slug").isin(writers)})
    kind = (F.when((F.col("rankable_rows") == 0) | (viable == 0), "excluded")
            .when(F.col("blocked_rows") > 0, "mixed").otherwise("viable"))
    status = (F.when(F.col("rankable_rows") == 0, "FAIL")
              .when((F.col("classification") == "excluded") | ~F.col("writer_supported"), "WARN")
              .when((F.col("classification") == "mixed") | (viable < target_batch), "WARN").otherwise("PASS"))
    out = (
        rows.withColumn("blocked_rows", n - viable).withColumn("classification", kind)
        .withColumn("fill_rate_percent", percent(viable, n))
        .withColumn("scan_rows_needed", F.when((viable > 0) & (n > 0), F.ceil(F.lit(float(target_batch)) / (viable / n))).cast("bigint"))
        .withColumn("recommended_batch", F.when(F.col("classification") == "excluded", F.lit(0).cast("bigint")).otherwise(
            F.least(F.lit(target_batch).cast("bigint"), viable)))
        .withColumn("status", status)
    )
    for target in targets:
        needed = F.greatest(F.lit(0), F.ceil(F.col("rankable_rows") * F.lit(target / 100)) - F.col("fresh_rows")).cast("bigint")
        out = out.withColumn(f"rows_to_{target}", needed).withColumn(f"chunks_to_{target}", F.when(
            F.col("recommended_batch") > 0, F.ceil(F.col(f"rows_to_{target}") / F.col("recommended_batch"))).otherwise(0).cast("bigint"))
    return out


def capacity_verdict(capacity: DataFrame) -> DataFrame:
    """One row over all sources: FAIL without sources, rankable rows or viable rows, or with a failed source."""
    none = (F.col("sources") == 0) | (F.col("rankable_rows") == 0) | (F.col("viable_rows") == 0)
    return capacity.agg(
        F.count("*").alias("sources"), F.coalesce(F.sum("rankable_rows"), F.lit(0)).alias("rankable_rows"),
        F.coalesce(F.sum("viable_rows"), F.lit(0)).alias("viable_rows"),
        F.count_if(F.col("status") == "FAIL").alias("failed_sources"), F.count_if(F.col("status") == "WARN").alias("warned_sources"),
    ).withColumn("status", verdict_of(none | (F.col("failed_sources") > 0), F.col("warned_sources") > 0))


def capacity_evidence(selected: DataFrame, capacity: DataFrame, evidence: DataFrame, sample: int) -> DataFrame:
    """Selected rows checked against the capacity evidence of their source."""
    source = capacity.select("source_slug", F.struct(
        "writer_supported", "classification", F.col("status").alias("source_status"), "viable_rows", "recommended_batch").alias("c"))
    row = evidence.select("source_slug", "id", F.col("status").alias("evidence_status"))
    missing = F.col("c").isNull()
    checks = [
        ("no_capacity_source", missing), ("not_writer_supported", ~F.col("c.writer_supported")),
        ("source_excluded", F.col("c.classification") == "excluded"), ("source_failed", F.col("c.source_status") == "FAIL"),
        ("too_few_viable_rows", F.col("c.viable_rows") < sample), ("batch_below_sample", F.col("c.recommended_batch") < sample),
        ("row_not_in_evidence", ~missing & F.col("evidence_status").isNull()), ("row_not_passed", F.col("evidence_status") != "PASS")]
    return selected.select("source_slug", "id").join(source, "source_slug", "left").join(row, ["source_slug", "id"], "left").select(
        "source_slug", "id", reasons(checks).alias("reasons"))


def select_refresh_rows(evaluated: DataFrame, sample: int, evidence: DataFrame | None = None) -> DataFrame:
    """First ``sample`` passing rows per source, least recently checked first, with a shortfall flag.

    Spark cuts each partition to ``sample`` rows per source before the shuffle.
    """
    passed = evaluated.filter(F.col("status") == "PASS")
    if evidence is not None:
        passed = passed.join(evidence.filter(F.col("status") == "PASS").select("source_slug", "id"), ["source_slug", "id"], "left_semi")
    order = Window.partitionBy("source_slug").orderBy("last_checked_at", "id")
    chosen = passed.withColumn("pick", F.row_number().over(order).cast("bigint")).filter(F.col("pick") <= sample)
    # at most ``sample`` rows per source are left here; counting them in place keeps the guards from running twice
    picked = F.count("*").over(Window.partitionBy("source_slug"))
    return chosen.withColumn("picked", picked).withColumn("short", F.col("picked") < sample)


def apply_refresh(current: DataFrame, plan: DataFrame, now) -> DataFrame:
    """Rows updated where id, EAN, SKU and source all agree with the plan; the row count never changes."""
    keys = ["id", "ean", "sku_id", "source_slug"]
    new = plan.select(*keys, F.struct(F.col("live.price").alias("price"), F.col("live.list_price").alias("list_price"),
                                      F.col("live.is_available").alias("is_available")).alias("new"))
    hit = F.col("new").isNotNull()
    return current.join(new, keys, "left").withColumns({
        "price": F.when(hit, F.col("new.price")).otherwise(F.col("price")),
        "list_price": F.when(hit, F.coalesce("new.list_price", "list_price")).otherwise(F.col("list_price")),
        "is_available": F.when(hit, F.col("new.is_available")).otherwise(F.col("is_available")),
        "last_checked_at": F.when(hit, at(now)).otherwise(F.col("last_checked_at")),
        "refreshed": hit}).drop("new")


# -- feasibility ---------------------------------------------------------------------
def match_feasibility(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Whether a row can be refreshed directly: SKU lookup first, then EAN.

    A lookup without result falls through to the next kind; several results are ambiguous.
    """
    by_ean = live.filter(has_text(F.col("ean"))).groupBy("source_slug", "ean").agg(
        F.count("*").alias("ean_live"), F.min(F.struct(F.col("product_url").alias("url"))).alias("ean_product"))
    own = rows.filter(has_text(F.col("ean"))).groupBy("source_slug", "ean").agg(F.count("*").alias("ean_rows"))
    joined = with_live(rows, live).join(by_ean, ["source_slug", "ean"], "left").join(own, ["source_slug", "ean"], "left")
    has_sku, has_ean = has_text(F.col("sku_id")), has_text(F.col("ean"))
    host = url_host(F.col("product_url"))
    sku_hit, ean_hit = F.col("live_count") > 0, F.coalesce(F.col("ean_live"), F.lit(0)) > 0

    def drift(url: str) -> Column:
        return F.coalesce(host != url_host(F.col(url)), F.lit(False))

    by_sku = (F.when(F.col("live_count") > 1, "ambiguous:several_live")
              .when(~F.coalesce(F.col("live.ean") == F.col("ean"), F.lit(False)), "unviable:ean_mismatch")
              .when(drift("live.url"), "unviable:host_drift").otherwise("viable:matched"))
    via_ean = (F.when(F.col("ean_live") > 1, "ambiguous:several_live")
               .when(drift("ean_product.url"), "unviable:host_drift")
               .when(F.col("ean_rows") != 1, "ambiguous:several_rows").otherwise("viable:matched"))
    kind = F.when(has_sku & sku_hit, "sku").when(has_ean & ean_hit, "ean")
    nothing = (F.when(has_sku | has_ean, "unviable:no_live_match").when(has_text(F.col("product_url")), "unviable:url_lookup_only")
               .otherwise("unviable:no_identifier"))
    outcome = F.when(kind == "sku", by_sku).when(kind == "ean", via_ean).otherwise(nothing)
    attempted = F.when(has_sku, "sku").when(has_ean, "ean").when(has_text(F.col("product_url")), "url")
    return joined.withColumn("_o", F.split(outcome, ":")).select(
        "id", "source_slug", F.coalesce(kind, attempted).alias("lookup"), F.get("_o", F.lit(0)).alias("status"),
        F.get("_o", F.lit(1)).alias("reason"))


def feasibility_advice(decisions: DataFrame) -> DataFrame:
    """Advice per source from the row decisions."""
    n, viable, unviable = F.col("rows"), F.col("viable"), F.col("unviable")
    return decisions.groupBy("source_slug").agg(
        F.count("*").alias("rows"), F.count_if(F.col("status") == "viable").alias("viable"),
        F.count_if(F.col("status") == "ambiguous").alias("ambiguous"), F.count_if(F.col("status") == "unviable").alias("unviable"),
    ).withColumns({
        "advice": F.when(unviable == n, "stop").when(viable == n, "direct-refresh").when(viable > 0, "search-fallback")
        .otherwise("larger-bounded-chunks"),
        "status": verdict_of(unviable == n, viable < n)})


# -- drift ---------------------------------------------------------------------------
def first_candidates(live: DataFrame, order: list[str]) -> DataFrame:
    """First live row per (source, EAN) in the given order."""
    cols = [c for c in live.columns if c not in ("source_slug", "ean")]
    return live.groupBy("source_slug", "ean").agg(
        F.min_by(F.struct(*cols), F.struct(*order)).alias("f")).select("source_slug", "ean", "f.*")


def price_drift(live: DataFrame, products: DataFrame, current: DataFrame, warn: float = 50.0, stop: float = 200.0) -> DataFrame:
    """Class and quality flags of every live row against the stored price.

    A pair without a computable change counts as changed.
    """
    known = products.select("ean", F.lit(True).alias("has_product"))
    stored = current.select("source_slug", "ean", F.col("price").alias("db_price"), F.col("id").alias("db_id"))
    joined = live.join(known, "ean", "left").join(stored, ["source_slug", "ean"], "left")
    delta = drift_percent(F.col("db_price"), F.col("price"))
    size = F.abs(F.col("delta_percent"))
    kind = (F.when(~positive(F.col("price")), "invalid_live_price")
            .when(F.col("has_product").isNull(), "missing_product").when(F.col("db_id").isNull(), "missing_source_row")
            .when(size > stop, "stop").when(size > warn, "warn").when(size == 0, "unchanged").otherwise("changed"))
    flags = reasons([
        ("invalid-live-price", ~positive(F.col("price"))),
        *[(f"mojibake:{c}", has_broken_text(F.col(c))) for c in ("name", "brand", "description", "category")],
        ("missing-product-url", ~has_text(F.col("product_url")))])
    return joined.withColumn("delta_percent", delta).withColumn("class", kind).withColumn("flags", flags)


def drift_summary(drift: DataFrame, duplicates: DataFrame, health: DataFrame) -> DataFrame:
    """Counts per source and the overall status; duplicates has (source_slug, duplicate_eans)."""
    def n(kind: str) -> Column:
        return F.count_if(F.col("class") == kind).alias(kind)

    kinds = ("unchanged", "changed", "warn", "stop", "missing_product", "missing_source_row", "invalid_live_price")
    counted = drift.groupBy("source_slug").agg(
        F.count("*").alias("live_rows"), *[n(k) for k in kinds], F.max(F.abs("delta_percent")).alias("max_abs_delta_percent"))
    fails = ~F.col("is_healthy") | ~F.col("hash_valid") | (F.col("stop") > 0) | (F.col("invalid_live_price") > 0)
    warns = (F.col("warn") > 0) | (F.col("missing_product") > 0) | (F.col("missing_source_row") > 0) | (F.col("duplicate_eans") > 0)
    return (
        counted.join(duplicates, "source_slug", "left").join(health.select("source_slug", "is_healthy", "hash_valid"), "source_slug", "left")
        .withColumns({"duplicate_eans": F.coalesce("duplicate_eans", F.lit(0)), "is_healthy": F.coalesce("is_healthy", F.lit(False)),
                      "hash_valid": F.coalesce("hash_valid", F.lit(False))})
        .withColumn("status", verdict_of(fails, warns))
    )


def key_set_differences(expected: DataFrame, actual: DataFrame, group: str, key: str) -> DataFrame:
    """Keys missing from or extra in a group, and keys repeated on either side."""
    e = expected.groupBy(group, key).agg(F.count("*").alias("expected_n"))
    a = actual.groupBy(group, key).agg(F.count("*").alias("actual_n"))
    joined = e.join(a, [group, key], "full_outer").withColumns({
        "expected_n": F.coalesce("expected_n", F.lit(0)), "actual_n": F.coalesce("actual_n", F.lit(0))})
    issues = reasons([
        ("missing", F.col("actual_n") == 0), ("extra", F.col("expected_n") == 0),
        ("duplicate_expected", F.col("expected_n") > 1), ("duplicate_actual", F.col("actual_n") > 1)])
    return joined.select(group, key, F.explode(issues).alias("issue"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Members of a multiset that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)
