"""Composite audits over plans, batches, audit results and controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.freshness import at
from ..functions.identity import four_decimals
from ..functions.numeric import drift_percent, positive
from ..functions.quality import has_text
from ..functions.rules import reasons, verdict_of
from ..functions.text import has_broken_text
from ..functions.web import url_host
from ..sources.stable import previous_in_order

# Text fields that are searched for broken characters.
TEXT_FIELDS = ("name", "brand", "description", "category", "reference_unit")


# -- change sets -----------------------------------------------------------------------
def change_set(pairs: DataFrame, key: str, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(key, field, before, after) where the two sides differ.

    Numbers compare at four decimals and arrays as sorted sets; callers pass the
    canonical text of both sides per field.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("field"), b.cast("string").alias("before"), a.cast("string").alias("after"))
                      for name, (b, a) in fields.items()])
    changed = F.filter(cells, lambda c: ~c["before"].eqNullSafe(c["after"]))
    return pairs.select(key, F.explode(changed).alias("c")).select(key, "c.*")


def number_pair(before: Column, after: Column) -> tuple[Column, Column]:
    return four_decimals(before), four_decimals(after)


def set_pair(before: Column, after: Column) -> tuple[Column, Column]:
    return F.array_join(F.array_sort(before), ","), F.array_join(F.array_sort(after), ",")


# -- candidates -------------------------------------------------------------------------
def broken_text(candidates: DataFrame, waivers: DataFrame, pattern: str) -> DataFrame:
    """(ean, field) with damaged encoding that no waiver covers."""
    cells = F.filter(F.array(*[F.when(has_broken_text(F.col(f), pattern), F.lit(f)) for f in TEXT_FIELDS if f in candidates.columns]),
                     lambda f: f.isNotNull())
    found = candidates.select("ean", F.explode(cells).alias("field")).distinct()
    allowed = waivers.filter(has_text(F.col("reason"))).select("ean", "field").distinct()
    return found.join(allowed, ["ean", "field"], "left_anti")


def existing_only_selection(candidates: DataFrame, products: DataFrame, current: DataFrame, count: int, order: list[str]) -> DataFrame:
    """selected, missing_product, missing_store_row or overflow per candidate and source.

    Only the first ``count`` rows of a source are ranked; the cut happens before the shuffle.
    """
    known = products.select("ean", F.lit(True).alias("_p"))
    own = current.select("source_slug", "ean", F.lit(True).alias("_r")).distinct()
    joined = candidates.join(known, "ean", "left").join(own, ["source_slug", "ean"], "left")
    gap = F.when(F.col("_p").isNull(), "missing_product").when(F.col("_r").isNull(), "missing_store_row")
    marked = joined.withColumn("_gap", gap).drop("_p", "_r")
    first = Window.partitionBy("source_slug").orderBy(*order)
    top = marked.filter(F.col("_gap").isNull()).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= count)
    cut = top.groupBy("source_slug").agg(F.max(F.struct(*order)).alias("_last"))  # one row per source
    here = F.struct(*order)
    return marked.join(cut, "source_slug", "left").withColumn(
        "outcome", F.coalesce("_gap", F.when(here <= F.col("_last"), "selected").otherwise("overflow"))).drop("_gap", "_last")


def candidate_checks(candidates: DataFrame, expected: int, unwaived: DataFrame) -> DataFrame:
    """Per source: exact distinct count, positive prices, clean text."""
    bad = unwaived.select("ean").distinct().withColumn("_bad", F.lit(True))
    per_ean = candidates.join(bad, "ean", "left").groupBy("source_slug", "ean").agg(
        F.count("*").alias("n"), F.count_if(~positive(F.col("price"))).alias("p"), F.max("_bad").alias("b"))
    out = per_ean.groupBy("source_slug").agg(
        F.sum("n").alias("rows"), F.count("*").alias("eans"), F.sum("p").alias("bad_prices"), F.count("b").alias("broken_eans"))
    return out.withColumn("reasons", reasons([
        ("count_differs", (F.col("rows") != expected) | (F.col("eans") != expected)),
        ("price_not_positive", F.col("bad_prices") > 0), ("broken_text", F.col("broken_eans") > 0)]))


# -- batches ---------------------------------------------------------------------------
def pre_reconcile_gate(expected: DataFrame, candidates: DataFrame, queries: DataFrame, expected_queries: int = 1,
                       fingerprints: DataFrame | None = None) -> DataFrame:
    """Reasons that stop a batch before the merge.

    expected: batch_id, ean; candidates: batch_id, source_slug, ean, price, status;
    queries: batch_id, queries_sent; fingerprints: batch_id, expected, actual.
    """
    e = expected.groupBy("batch_id", "ean").agg(F.count("*").alias("en"))
    a = candidates.groupBy("batch_id", "ean").agg(
        F.count("*").alias("an"), F.count_if(F.col("status") == "REJECTED").alias("rej"), F.count_if(F.col("status") != "PENDING").alias("np"),
        F.count_if(~positive(F.col("price"))).alias("bp"), F.min("source_slug").alias("s0"), F.max("source_slug").alias("s1"))
    sets = e.join(a, ["batch_id", "ean"], "full_outer").groupBy("batch_id").agg(
        F.coalesce(F.sum("en"), F.lit(0)).alias("expected_rows"), F.coalesce(F.sum("an"), F.lit(0)).alias("actual_rows"),
        F.count("an").alias("actual_eans"), F.count_if(F.col("en") > 1).alias("dup_expected"),
        F.count_if(F.col("an").isNull() | F.col("en").isNull()).alias("set_diff"), F.sum("rej").alias("rejected"),
        F.sum("np").alias("not_pending"), F.sum("bp").alias("bad_price"), F.min("s0").alias("s0"), F.max("s1").alias("s1"))
    joined = sets.join(queries, "batch_id", "left")
    checks = [
        ("nothing_expected", F.col("expected_rows") == 0), ("expected_not_distinct", F.col("dup_expected") > 0),
        ("not_one_source", F.col("s0").isNull() | (F.col("s0") != F.col("s1"))),
        ("query_count", F.coalesce("queries_sent", F.lit(0)) != expected_queries), ("rejected_rows", F.col("rejected") > 0),
        ("row_count", F.col("actual_rows") != F.col("expected_rows")), ("distinct_count", F.col("actual_eans") != F.col("expected_rows")),
        ("not_pending", F.col("not_pending") > 0), ("price_not_positive", F.col("bad_price") > 0), ("ean_set", F.col("set_diff") > 0)]
    if fingerprints is not None:
        joined = joined.join(fingerprints, "batch_id", "left")
        checks.insert(4, ("fingerprint", ~F.col("expected").eqNullSafe(F.col("actual"))))
    return joined.select("batch_id", reasons(checks).alias("reasons")).withColumn(
        "status", F.when(F.size("reasons") == 0, "PASS").otherwise("FAIL"))


def run_aggregate(chunks: DataFrame, touched: DataFrame, mode: str = "refresh-existing") -> DataFrame:
    """Chunks of a batch taken together.

    chunks: batch_id, chunk_id, source_slug, status, phase, write_mode, new_products, created_rows;
    touched: batch_id, chunk_id, ean.
    """
    per_batch = chunks.groupBy("batch_id").agg(
        F.count("*").alias("chunks"), F.count_if((F.col("status") != "PASS") | (F.col("phase") != "post-write")).alias("not_passed"),
        F.count_if(~F.coalesce(F.col("write_mode") == mode, F.lit(False))).alias("other_mode"),
        F.count_if(F.col("new_products").isNull() | F.col("created_rows").isNull()).alias("no_evidence"),
        F.count_distinct("source_slug").alias("sources"), F.sum("new_products").alias("new_products"), F.sum("created_rows").alias("created_rows"))
    eans = touched.groupBy("batch_id", "ean").agg(F.count("*").alias("n")).groupBy("batch_id").agg(
        F.sum("n").alias("touched_eans"), F.count_if(F.col("n") > 1).alias("repeated_eans"))
    checks = [
        ("chunk_not_passed", F.col("not_passed") > 0), ("write_mode", F.col("other_mode") > 0), ("evidence_missing", F.col("no_evidence") > 0),
        ("mixed_sources", F.col("sources") != 1), ("repeated_eans", F.col("repeated_eans") > 0)]
    if mode == "refresh-existing":
        checks.append(("created_rows", (F.col("new_products") > 0) | (F.col("created_rows") > 0)))
    return per_batch.join(eans, "batch_id", "left").withColumns({
        "touched_eans": F.coalesce("touched_eans", F.lit(0)), "repeated_eans": F.coalesce("repeated_eans", F.lit(0))}).select(
        "batch_id", "chunks", "touched_eans", "new_products", "created_rows", reasons(checks).alias("reasons")).withColumn(
        "status", F.when(F.size("reasons") == 0, "PASS").otherwise("FAIL"))


def row_equality(expected: DataFrame, actual: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows that are missing, extra or differ, with the differing columns."""
    e = expected.select(*keys, F.struct(*columns).alias("e"))
    a = actual.select(*keys, F.struct(*columns).alias("a"))
    both = F.col("e").isNotNull() & F.col("a").isNotNull()
    checks = reasons([
        ("missing", F.col("a").isNull()), ("extra", F.col("e").isNull()),
        *[(c, both & ~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}"))) for c in columns]])
    return e.join(a, keys, "full_outer").select(*keys, checks.alias("differences")).filter(F.size("differences") > 0)


def post_run_audit(expected: DataFrame, actual: DataFrame, before: DataFrame, warn: float = 50.0, stop: float = 200.0) -> DataFrame:
    """Current rows after a merge against the candidates, with the price-change gate per row.

    All sides are keyed by (product_ean, supermarket_id).
    """
    keys = ["product_ean", "supermarket_id"]
    columns = ["price", "list_price", "is_available", "sku_id", "seller_id", "product_url"]
    e = expected.select(*keys, F.struct(*[F.col(c).cast(actual.schema[c].dataType).alias(c) for c in columns]).alias("e"))
    a = actual.select(*keys, F.struct(*columns).alias("a"))
    old = before.select(*keys, F.col("price").alias("old_price"))
    both = F.col("e").isNotNull() & F.col("a").isNotNull()
    size = F.abs(drift_percent(F.col("old_price"), F.col("e.price")))
    checks = reasons([
        ("missing", F.col("a").isNull()), ("price_not_positive", both & ~positive(F.col("a.price"))),
        *[(f"{c}_differs", both & ~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}"))) for c in columns], ("price_change_stop", size > stop)])
    return e.join(a, keys, "left").join(old, keys, "left").select(*keys, checks.alias("reasons"), (size > warn).alias("large_change")).withColumn(
        "status", verdict_of(F.size("reasons") > 0, F.coalesce("large_change", F.lit(False)))).drop("large_change")


def rollback_equality(snapshot: DataFrame, restored: DataFrame) -> DataFrame:
    """Rows only in the snapshot and only in the restored table; both must be 0."""
    columns = snapshot.columns
    both = snapshot.withColumn("_s", F.lit(1)).unionByName(restored.select(*columns).withColumn("_s", F.lit(-1)))
    net = both.groupBy(*columns).agg(F.sum("_s").alias("net"))
    return net.agg(
        F.coalesce(F.sum(F.greatest(F.lit(0), F.col("net"))), F.lit(0)).alias("only_in_snapshot"),
        F.coalesce(F.sum(F.greatest(F.lit(0), -F.col("net"))), F.lit(0)).alias("only_in_restored")).withColumn(
        "status", F.when((F.col("only_in_snapshot") == 0) & (F.col("only_in_restored") == 0), "PASS").otherwise("FAIL"))


def post_write_audit(plan: DataFrame, current: DataFrame, expected_history: DataFrame, new_history: DataFrame) -> DataFrame:
    """Refreshed rows against the plan and the exact set of new history rows.

    plan and current share id, ean, sku_id, price, is_available; the history sides share history_id, id, price.
    """
    columns = ["ean", "sku_id", "price", "is_available"]
    p = plan.select("id", F.struct(*columns).alias("e"))
    c = current.select("id", F.struct(*columns).alias("a"))
    rows = p.join(c, "id", "left").select("id", reasons([
        ("row_missing", F.col("a").isNull()),
        *[(f"{n}_differs", F.col("a").isNotNull() & ~F.col(f"e.{n}").eqNullSafe(F.col(f"a.{n}"))) for n in columns]]).alias("r"))
    eh = expected_history.select("history_id", F.struct("id", "price").alias("e"))
    nh = new_history.select("history_id", F.struct("id", "price").alias("a"))
    history = eh.join(nh, "history_id", "full_outer").select(F.coalesce("e.id", "a.id").alias("id"), reasons([
        ("history_missing", F.col("a").isNull()), ("history_unexpected", F.col("e").isNull()),
        ("history_owner_differs", F.col("e.id") != F.col("a.id")), ("history_price_differs", ~F.col("e.price").eqNullSafe(F.col("a.price")) & F.col("e").isNotNull() & F.col("a").isNotNull()),
    ]).alias("r"))
    return rows.unionByName(history).select("id", F.explode("r").alias("reason")).distinct()


# -- source health ------------------------------------------------------------------------
def source_health_verdicts(sources: DataFrame, health: DataFrame, capacity: DataFrame, expected_hosts: DataFrame,
                           writers: list[str], rapid_sources: list[str] = (), rapid_scan: int = 100) -> DataFrame:
    """Reasons and status per expected source from its record, freshness and capacity."""
    rec = sources.select(F.col("slug").alias("source_slug"), F.lit(True).alias("exists"), "is_active", "is_vtex", "base_url")
    fresh = health.select("source_slug", F.col("status").alias("fresh_status"))
    cap = capacity.select("source_slug", F.struct("status", "classification", "blocked_rows", "scan_rows_needed").alias("c"))
    joined = expected_hosts.join(rec, "source_slug", "left").join(fresh, "source_slug", "left").join(cap, "source_slug", "left")
    here, host = F.coalesce("exists", F.lit(False)), url_host(F.col("base_url"))
    fails = [
        ("record_missing", ~here), ("inactive", here & ~F.coalesce("is_active", F.lit(False))), ("platform_unsupported", here & ~F.coalesce("is_vtex", F.lit(False))),
        ("base_url_invalid", host.isNull()), ("base_url_host", host != F.col("expected_host")),
        ("freshness_failed", F.coalesce("fresh_status", F.lit("FAIL")) == "FAIL"), ("capacity_failed", F.col("c.status") == "FAIL")]
    warns = [
        ("audit_only", ~F.col("source_slug").isin(writers)), ("freshness_below_target", F.col("fresh_status") == "WARN"),
        ("capacity_not_provided", F.col("c").isNull()), ("capacity_warning", F.coalesce("c.status", F.lit("WARN")) == "WARN"),
        ("capacity_mixed", F.col("c.classification") == "mixed"), ("blocked_rows", F.col("c.blocked_rows") > 0),
        ("rapid_confirmation", F.col("source_slug").isin(list(rapid_sources)) & (F.col("c.scan_rows_needed") >= rapid_scan))]
    return joined.withColumns({"f": reasons(fails), "w": reasons(warns)}).select(
        "source_slug", F.array_sort(F.concat("f", "w")).alias("reasons"), verdict_of(F.size("f") > 0, F.size("w") > 0).alias("status"))


# -- alerts -------------------------------------------------------------------------------
# Severity and owner of every alert condition.
ALERT_POLICY = (
    ("source_health_fail", "HIGH", "operator"),
    ("source_health_warn", "MEDIUM", "operator"),
    ("freshness_baseline_fail", "HIGH", "operator"),
    ("freshness_baseline_warn", "MEDIUM", "operator"),
    ("manifest_fail", "HIGH", "operator"),
    ("prewrite_fail", "HIGH", "operator"),
    ("prewrite_stale", "HIGH", "operator"),
    ("confirmation_mismatch", "HIGH", "operator"),
    ("active_writer_timeout", "CRITICAL", "operator and maintainer"),
    ("prisma_pool_exhaustion", "HIGH", "operator and maintainer"),
    ("prisma_transaction_not_found", "CRITICAL", "operator and maintainer"),
    ("postwrite_fail", "CRITICAL", "operator and maintainer"),
    ("no_create_invariant_violation", "CRITICAL", "maintainer"),
    ("no_partial_verification_fail", "CRITICAL", "maintainer"),
    ("missing_postwrite_artifact", "HIGH", "operator"),
    ("missing_baseline_artifact", "HIGH", "operator"),
)
# Error texts that identify a condition.
TRANSACTION_LOST = "transaction not found|p2028"
POOL_EXHAUSTED = "timed out fetching a new connection|connection pool|pool exhaustion|p2024"
TIMED_OUT = "timeout|timed out|transaction api error"
STALE_EVIDENCE = "prewrite report is stale|maximum age is 15 minutes|stale prewrite"
MISMATCH = "hash mismatch|row ids? mismatch|product eans? mismatch|sku ids? mismatch|confirmation.*mismatch|mismatch.*confirmation"


def alert_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALERT_POLICY, "condition string, severity string, owner string")


def classify_alerts(results: DataFrame, now, max_prewrite_minutes: int = 15) -> DataFrame:
    """Alert conditions of audit results with severity and owner, most severe first.

    results: id, kind, source_slug, status, generated_at, message, product_delta, row_delta.
    """
    kind, failed = F.col("kind"), F.col("status") == "FAIL"
    text = F.lower(F.coalesce("message", F.lit("")))
    error = kind == "error"
    stale_age = F.unix_micros(at(now)) - F.unix_micros("generated_at") > F.lit(max_prewrite_minutes * 60_000_000)
    created = (F.coalesce("product_delta", F.lit(0)) != 0) | (F.coalesce("row_delta", F.lit(0)) != 0)
    lost, pool, late = text.rlike(TRANSACTION_LOST), text.rlike(POOL_EXHAUSTED), text.rlike(TIMED_OUT)
    rules = [
        ("source_health_fail", (kind == "source_health") & failed), ("source_health_warn", (kind == "source_health") & (F.col("status") == "WARN")),
        ("freshness_baseline_fail", (kind == "freshness_baseline") & failed),
        ("freshness_baseline_warn", (kind == "freshness_baseline") & (F.col("status") == "WARN")),
        ("manifest_fail", (kind == "manifest") & failed), ("prewrite_fail", (kind == "prewrite") & failed),
        ("postwrite_fail", (kind == "postwrite") & failed), ("no_partial_verification_fail", (kind == "no_partial") & failed),
        ("no_create_invariant_violation", kind.isin("postwrite", "active_write") & created),
        ("prisma_transaction_not_found", error & lost), ("prisma_pool_exhaustion", error & ~lost & pool),
        ("active_writer_timeout", error & ~lost & ~pool & late),
        ("prewrite_stale", ((kind == "prewrite") & stale_age) | (error & text.rlike(STALE_EVIDENCE))),
        ("confirmation_mismatch", error & text.rlike(MISMATCH))]
    found = results.select("id", "source_slug", F.explode(reasons(rules)).alias("condition"))
    return found.join(alert_policy(results.sparkSession), "condition")


def missing_artifacts(operations: DataFrame, results: DataFrame, required: dict[str, str]) -> DataFrame:
    """Alerts for operations that lack a required kind of result; ``required`` maps kind to condition."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("condition")) for k, c in required.items()]))
    wanted = operations.select("operation_id", kinds.alias("k")).select("operation_id", "k.*")
    have = results.select("operation_id", "kind").distinct()
    return wanted.join(have, ["operation_id", "kind"], "left_anti").join(alert_policy(operations.sparkSession), "condition")


# -- controls and ledger ---------------------------------------------------------------------
def stop_controls(controls: DataFrame, sources: DataFrame, now) -> DataFrame:
    """State of every stop control: invalid, active, expired or inactive.

    controls: id, scope (global or source), source, stop, reason, owner, expires_at.
    """
    known = sources.select(F.col("slug").alias("source"), F.lit(True).alias("_known"))
    expired = F.coalesce(F.col("expires_at") <= at(now), F.lit(False))
    state = (F.when((F.col("scope") == "source") & F.col("_known").isNull(), "invalid").when(F.col("stop").isNull(), "invalid")
             .when(F.col("stop") & ~expired & ~(has_text(F.col("reason")) & has_text(F.col("owner"))), "active_incomplete")
             .when(F.col("stop") & ~expired, "active").when(expired, "expired").otherwise("inactive"))
    return controls.join(known, "source", "left").select("id", "scope", "source", state.alias("state"))


def stop_status(states: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: active own and global stops, invalid controls anywhere, and the verdict."""
    active = F.col("state").isin("active", "active_incomplete")
    totals = states.agg(
        F.count_if((F.col("scope") == "global") & active).alias("g"),
        F.count_if(F.col("state").isin("invalid", "active_incomplete")).alias("i"))
    own = states.filter(F.col("scope") == "source").groupBy(F.col("source").alias("slug")).agg(F.count_if(active).alias("own_stops"))
    return sources.select("slug").join(own, "slug", "left").withColumns({
        "own_stops": F.coalesce("own_stops", F.lit(0)), "global_stops": totals.select("g").scalar(), "invalid_controls": totals.select("i").scalar()}).withColumn(
        "status", F.when(F.col("own_stops") + F.col("global_stops") + F.col("invalid_controls") > 0, "FAIL").otherwise("PASS"))


ACTIVE_STATES = ("PLANNED", "RUNNING")
# Allowed next states of a refresh run.
NEXT_STATES = {"PLANNED": ("RUNNING", "STOPPED", "FAILED"), "RUNNING": ("COMPLETED", "STOPPED", "FAILED")}


def ledger_conflicts(ledger: DataFrame) -> DataFrame:
    """Sources with more than one active run."""
    return ledger.filter(F.col("status").isin(*ACTIVE_STATES)).groupBy("source_slug").agg(
        F.count("*").alias("active_runs")).withColumn("conflict", F.col("active_runs") > 1)


def ledger_transitions(log: DataFrame) -> DataFrame:
    """Every status row of a run against its predecessor: first, allowed, terminal or not_allowed."""
    steps = previous_in_order(log.select("run_key", "at", "id", "status"), "run_key", ["at", "id"], "status", "previous")
    allowed = F.lit(False)
    for state, following in NEXT_STATES.items():
        allowed = allowed | ((F.col("previous") == state) & F.col("status").isin(*following))
    verdict = (F.when(F.col("is_first"), "first").when(~F.col("previous").isin(*NEXT_STATES), "terminal")
               .when(allowed, "allowed").otherwise("not_allowed"))
    return steps.select("id", "run_key", "previous", "status", verdict.alias("transition"))


# -- operations ------------------------------------------------------------------------------
# Results without which an operation is incomplete.
REQUIRED_KINDS = ("manifest", "prewrite", "active_write", "postwrite")


def operation_blockers(results: DataFrame, operations: DataFrame, require: bool = True) -> DataFrame:
    """(operation_id, source, kind, reason, severity) over all audit results of an operation.

    results: operation_id, kind, source_slug, status, product_delta, row_delta, fail_closed_reasons.
    """
    kind, status = F.col("kind"), F.col("status")
    by_status = kind.isin("source_health", "freshness_baseline", "alerts")
    severity = (F.when(by_status & (status == "FAIL"), "HIGH").when(by_status & (status == "WARN"), "MEDIUM")
                .when(kind.isin("postwrite", "no_partial") & (status == "FAIL"), "CRITICAL").when(status == "FAIL", "HIGH"))
    created = (F.coalesce("product_delta", F.lit(0)) != 0) | (F.coalesce("row_delta", F.lit(0)) != 0)
    own = F.filter(F.array(
        F.when(severity.isNotNull(), F.struct(F.concat(kind, F.lit("_"), F.lower(status)).alias("reason"), severity.alias("severity"))),
        F.when(kind.isin("postwrite", "active_write") & created, F.struct(F.lit("created_rows").alias("reason"), F.lit("CRITICAL").alias("severity")))),
        lambda b: b.isNotNull())
    closed = F.transform(F.coalesce("fail_closed_reasons", F.expr("cast(array() as array<string>)")),
                         lambda r: F.struct(r.alias("reason"), F.lit("HIGH").alias("severity")))
    found = results.select("operation_id", F.col("source_slug").alias("source"), "kind", F.explode(F.concat(own, closed)).alias("b")).select(
        "operation_id", "source", "kind", "b.reason", "b.severity")
    have = results.groupBy("operation_id").agg(F.collect_set("kind").alias("kinds"))  # a handful of kinds
    gaps = F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KINDS]), F.coalesce("kinds", F.expr("cast(array() as array<string>)")))
    incident = F.array_contains("kinds", "error") & ~F.array_contains("kinds", "no_partial")
    missing = F.concat(gaps if require else F.expr("cast(array() as array<string>)"),
                       F.when(F.coalesce(incident, F.lit(False)), F.array(F.lit("no_partial"))).otherwise(F.expr("cast(array() as array<string>)")))
    lacking = operations.select("operation_id").join(have, "operation_id", "left").select(
        "operation_id", F.lit(None).cast("string").alias("source"), F.explode(missing).alias("kind"),
        F.lit("required_but_missing").alias("reason"), F.lit("HIGH").alias("severity"))
    return found.unionByName(lacking)


def operation_status(blockers: DataFrame, operations: DataFrame) -> DataFrame:
    severe = F.col("severity").isin("CRITICAL", "HIGH")
    counted = blockers.groupBy("operation_id").agg(F.count("*").alias("blockers"), F.count_if(severe).alias("severe"),
                                                   F.count_distinct("source").alias("blocked_sources"))
    return operations.select("operation_id").join(counted, "operation_id", "left").withColumns({
        c: F.coalesce(c, F.lit(0)) for c in ("blockers", "severe", "blocked_sources")}).withColumn(
        "status", verdict_of(F.col("severe") > 0, F.col("blockers") > 0))
