"""Freshness audits, drift and refresh planning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import freshness as fo
from ..operators import refresh as op
from ..sources.derive import NOW, Tables, slug_of
from .registry import DERIVED, query

WRITERS = ["market-0", "market-1", "market-2", "market-3"]
SCAN, BATCH = 100, 25

# existing rows with deliberate gaps, and live answers to all of them; one in 53 answers under another SKU
DERIVED["rows"] = (("sp", "supermarkets", "products"), """
  SELECT sp.id, CASE WHEN sp.id % 41 = 0 THEN '' ELSE sp.product_ean END AS ean, CASE WHEN sp.id % 37 = 0 THEN ' ' ELSE p.name END AS product_name,
         s.slug AS source_slug, CASE WHEN sp.id % 31 = 0 THEN NULL WHEN sp.id % 43 = 0 THEN 0 ELSE sp.price END AS price, sp.list_price, sp.is_available, sp.sku_id,
         sp.product_url, CASE WHEN sp.id % 47 <> 0 THEN sp.last_checked_at END AS last_checked_at, s.freshness_sla_hours
  FROM sp JOIN supermarkets s ON s.id = sp.supermarket_id JOIN products p ON p.ean = sp.product_ean""")
DERIVED["live"] = (("sp",), """
  SELECT 'market-' || supermarket_id AS source_slug, product_ean AS ean, id // 6 AS k,
         CASE WHEN id % 53 = 0 THEN 'moved-' || (id // 6) WHEN (id // 6) % 23 <> 0 THEN 'sku-' || (id // 6) END AS sku_id,
         'https://www.market-' || supermarket_id || '.example.com/item-' || (id // 6) || '/p' AS product_url, copy, id,
         CASE WHEN id % 59 = 0 THEN 0 ELSE floor(price::double * (1 + (id % 7) * 0.5::double) * 100 + 0.5) / 100 END::decimal(10,2) AS price, list_price, id % 17 <> 0 AS is_available
  FROM sp, (VALUES (0), (1)) v(copy) WHERE copy = 0 OR id % 19 = 0""")
_HOST = "regexp_replace(lower(regexp_extract({}, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '')"
_CLASSIFIED = f"""
classified AS (SELECT *, CASE WHEN last_checked_at IS NULL THEN 'unknown' WHEN TIMESTAMP '{NOW}' - last_checked_at <= freshness_sla_hours * INTERVAL 1 HOUR THEN 'fresh' ELSE 'stale' END AS status,
  list_filter([CASE WHEN NOT is_available THEN 'unavailable' END, CASE WHEN price IS NULL THEN 'missing_price' WHEN price <= 0 THEN 'invalid_price' END,
    CASE WHEN trim(product_name) = '' THEN 'missing_name' END, CASE WHEN trim(ean) = '' THEN 'missing_ean' END], lambda x: x IS NOT NULL) AS why,
  greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_checked_at)) / 86400000000.0 AS age FROM rows),
bucketed AS (SELECT *, len(why) = 0 AS rankable, CASE WHEN status = 'unknown' THEN 'unknown' WHEN status = 'fresh' THEN 'within_sla' WHEN age <= 7 THEN 'up_to_7d' WHEN age <= 30 THEN 'up_to_30d' ELSE 'over_30d' END AS bucket FROM classified)"""
_PCT = "CASE WHEN {1} = 0 THEN 0 ELSE floor(({0})::double / ({1})::double * 100 * 100 + 0.5)/100 END"


def rows_of(t: Tables, current: DataFrame | None = None) -> DataFrame:
    k = F.col("id")
    stores = t.supermarkets.select(F.col("id").alias("supermarket_id"), F.col("slug").alias("source_slug"), "freshness_sla_hours")
    names = t.products.select(F.col("ean").alias("product_ean"), F.col("name").alias("product_name"))
    return (t.supermarket_products if current is None else current).join(stores, "supermarket_id").join(names, "product_ean").select(
        "id", F.when(k % 41 == 0, "").otherwise(F.col("product_ean")).alias("ean"),
        F.when(k % 37 == 0, " ").otherwise(F.col("product_name")).alias("product_name"), "source_slug",
        F.when(k % 31 == 0, None).when(k % 43 == 0, F.lit(0).cast("decimal(10,2)")).otherwise(F.col("price")).alias("price"),
        "list_price", "is_available", "sku_id", "product_url",
        F.when(k % 47 != 0, F.col("last_checked_at")).alias("last_checked_at"), "freshness_sla_hours")


def live_of(t: Tables, current: DataFrame | None = None) -> DataFrame:
    k, part = F.col("id"), F.floor(F.col("id") / 6)
    price = F.floor(F.col("price").cast("double") * (F.lit(1.0) + (k % 7) * F.lit(0.5)) * 100 + 0.5) / F.lit(100.0)
    copies = F.when(k % 19 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    moved = k % 53 == 0
    return (t.supermarket_products if current is None else current).select(
        slug_of(F.col("supermarket_id")).alias("source_slug"), F.col("product_ean").alias("ean"), part.alias("k"),
        F.when(moved, F.concat(F.lit("moved-"), part.cast("string"))).when(part % 23 != 0, F.concat(F.lit("sku-"), part.cast("string"))).alias("sku_id"),
        F.concat(F.lit("https://www."), slug_of(F.col("supermarket_id")), F.lit(".example.com/item-"), part.cast("string"), F.lit("/p")).alias("product_url"),
        F.explode(copies).alias("copy"), "id",
        F.when(k % 59 == 0, 0.0).otherwise(price).cast("decimal(10,2)").alias("price"), "list_price", (k % 17 != 0).alias("is_available"))


def hosts_of(t: Tables) -> DataFrame:
    return t.supermarkets.select(F.col("slug").alias("source_slug"), F.concat("slug", F.lit(".example.com")).alias("expected_host"))


# -- freshness baseline ----------------------------------------------------------------
_BASE_SQL = f"""{_CLASSIFIED},
per AS (SELECT source_slug, count(*) AS total_rows, count(*) FILTER (status='fresh') AS fresh_rows, count(*) FILTER (status='stale') AS stale_rows,
  count(*) FILTER (status='unknown') AS unknown_rows, count(*) FILTER (NOT is_available) AS unavailable_rows, count(*) FILTER (rankable) AS rankable_rows,
  count(*) FILTER (NOT rankable) AS excluded_rows, {', '.join(f"count(*) FILTER (list_contains(why, '{r}')) AS excluded_{r}" for r in fo.EXCLUSIONS)},
  {', '.join(f"count(*) FILTER (bucket = '{b}') AS age_{b}" for b in fo.BUCKETS)}, min(last_checked_at) AS oldest_check_at, max(last_checked_at) AS latest_check_at
  FROM bucketed GROUP BY GROUPING SETS ((source_slug), ())),
base AS (SELECT * REPLACE (coalesce(source_slug, 'all') AS source_slug), {_PCT.format('fresh_rows', 'total_rows')} AS freshness_percent FROM per)"""


@query("e18_freshness_baseline", "E18 B7 D20 D36", "rows", f"WITH {_BASE_SQL} SELECT * FROM base")
def freshness_baseline(t):
    return fo.freshness_baseline(rows_of(t), NOW)


@query("b07_exclusion_reasons", "B7 B8", "rows", f"WITH {_CLASSIFIED} SELECT id, array_to_string(why, ',') AS reasons, rankable FROM bucketed")
def exclusion_reasons(t):
    rows = fo.classified(rows_of(t), NOW)
    return rows.select("id", F.array_join("excluded_for", ",").alias("reasons"), "rankable")


@query("e19_ean_overlap", "E19", "rows", """
SELECT trim(ean) AS ean, arg_min(product_name, id) AS name, string_agg(DISTINCT source_slug, ',' ORDER BY source_slug) AS sources,
  count(DISTINCT source_slug) AS source_count FROM rows WHERE trim(ean) <> '' GROUP BY 1 ORDER BY source_count DESC, name, ean LIMIT 50""")
def ean_overlap(t):
    return fo.ean_overlap(rows_of(t), 50).withColumn("sources", F.array_join("sources", ","))


@query("g07_stale_examples", "G7", "rows", f"""WITH {_CLASSIFIED}
SELECT id, ean, source_slug, price::double AS price FROM bucketed WHERE status = 'stale' AND rankable ORDER BY price, id LIMIT 25""")
def stale_examples(t):
    return fo.stale_examples(rows_of(t), NOW, 25)


@query("g08_oldest_samples", "G8", "rows", """
SELECT source_slug, row_number() OVER w AS position, id, last_checked_at FROM rows WINDOW w AS (PARTITION BY source_slug ORDER BY last_checked_at NULLS LAST, id)
QUALIFY position <= 10""")
def oldest_samples(t):
    return fo.oldest_samples(rows_of(t))


_SCAN_SQL = f"""{_CLASSIFIED},
scan AS (SELECT *, row_number() OVER (PARTITION BY source_slug ORDER BY last_checked_at NULLS FIRST, id) AS scan_ord FROM bucketed WHERE rankable QUALIFY scan_ord <= {SCAN})"""


@query("g06_oldest_rankable", "G6", "rows", f"WITH {_SCAN_SQL} SELECT source_slug, scan_ord, id FROM scan")
def oldest_rankable(t):
    return fo.oldest_rankable(rows_of(t), SCAN).select("source_slug", F.col("scan_ord").cast("bigint").alias("scan_ord"), "id")


_DELTA_SQL = f"""{_CLASSIFIED},
cur AS (SELECT source_slug AS slug, count(*) FILTER (rankable) AS n FROM bucketed GROUP BY 1),
prev AS (SELECT source_slug AS slug, count(*) FILTER (is_available) AS n FROM bucketed GROUP BY 1),
cura AS (SELECT * FROM cur UNION ALL SELECT 'all', sum(n)::bigint FROM cur), preva AS (SELECT * FROM prev UNION ALL SELECT 'all', sum(n)::bigint FROM prev),
deltas AS (SELECT slug, coalesce(c.n, 0) AS current_rows, coalesce(p.n, 0) AS previous_rows, greatest(0, coalesce(p.n, 0) - coalesce(c.n, 0)) AS shrink_rows
  FROM cura c FULL JOIN preva p USING (slug)),
gated AS (SELECT *, {_PCT.format('shrink_rows', 'previous_rows')} AS shrink_percent,
  shrink_rows > 0 AND (shrink_rows > 10 OR shrink_rows::double / previous_rows * 100 > 1) AND slug NOT IN ('market-1') AS blocked FROM deltas)"""


def deltas_of(t: Tables) -> DataFrame:
    rows = fo.classified(rows_of(t), NOW)
    current = rows.groupBy(F.col("source_slug").alias("slug")).agg(F.count_if("rankable").alias("rows"))
    previous = rows.groupBy(F.col("source_slug").alias("slug")).agg(F.count_if("is_available").alias("rows"))
    explained = t.supermarkets.filter(F.col("slug") == "market-1").select("slug")
    return fo.denominator_deltas(current, previous, explained)


@query("e20_denominator_deltas", "E20", "rows", f"WITH {_DELTA_SQL} SELECT * FROM gated")
def denominator_deltas(t):
    return deltas_of(t)


@query("k02_baseline_status", "K2", "rows runs staging", f"""WITH {_BASE_SQL}, gate AS (SELECT count(*) FILTER (status = 'RUNNING') AS running FROM runs),
waiting AS (SELECT count(*) AS pending FROM staging),
cur AS (SELECT source_slug AS slug, rankable_rows AS n FROM base), prev AS (SELECT coalesce(source_slug, 'all') AS slug, count(*) FILTER (is_available) AS n FROM bucketed GROUP BY GROUPING SETS ((source_slug), ())),
blocked AS (SELECT bool_or(p.n > c.n AND (p.n - c.n > 10 OR (p.n - c.n)::double / p.n * 100 > 1) AND slug <> 'market-1') AS b FROM cur c JOIN prev p USING (slug))
SELECT total_rows, fresh_rows, freshness_percent, rankable_rows, (SELECT running FROM gate) AS running_runs, (SELECT pending FROM waiting) AS pending_rows,
  CASE WHEN (SELECT b FROM blocked) THEN 'FAIL' WHEN (SELECT running FROM gate) > 0 OR (SELECT pending FROM waiting) > 0 OR freshness_percent < 95 THEN 'WARN' ELSE 'PASS' END AS status
FROM base WHERE source_slug = 'all'""")
def baseline_status(t):
    return fo.baseline_status(rows_of(t), NOW, ["market-1"], t.ingestion_run, t.staging_product)


# -- source health and debt --------------------------------------------------------------
_HEALTH_SQL = f"""{_CLASSIFIED},
hh AS (SELECT source_slug, count(*) AS total_rows, count(*) FILTER (rankable) AS rankable_rows, count(*) FILTER (rankable AND status='fresh') AS fresh_rows,
  count(*) FILTER (rankable AND last_checked_at IS NULL) AS unknown_rows, count(*) FILTER (rankable AND status='stale') AS stale_rows,
  min(last_checked_at) FILTER (rankable) AS oldest_check_at, max(last_checked_at) FILTER (rankable) AS latest_check_at FROM bucketed GROUP BY 1),
health2 AS (SELECT *, {_PCT.format('fresh_rows', 'rankable_rows')} AS freshness_percent FROM hh)"""


@query("e27_source_freshness_health", "E27", "rows", f"""WITH {_HEALTH_SQL}
SELECT *, CASE WHEN rankable_rows = 0 THEN 'FAIL' WHEN freshness_percent < 95 THEN 'WARN' ELSE 'PASS' END AS status FROM health2""")
def source_freshness_health(t):
    return fo.source_health(rows_of(t), NOW)


_DEBT_SQL = f"""{_HEALTH_SQL},
debt AS (SELECT source_slug, target, target_percent, max_runs, greatest(0, ceil(rankable_rows * target_percent / 100.0) - fresh_rows)::bigint AS rows_needed, batch_size
  FROM health2, (VALUES ('recovery', 90, 4), ('final', 95, 2)) t(target, target_percent, max_runs), (VALUES (10), (25), (50)) b(batch_size)),
debts AS (SELECT *, ceil(rows_needed / batch_size)::bigint AS batches, ceil(rows_needed / batch_size) <= max_runs AS fits_window FROM debt)"""


def debt_of(t: Tables) -> DataFrame:
    return fo.freshness_debt(fo.source_health(rows_of(t), NOW), {"recovery": 4, "final": 2})


@query("e28_freshness_debt", "E28", "rows", f"WITH {_DEBT_SQL} SELECT * FROM debts")
def freshness_debt(t):
    return debt_of(t)


@query("e28_debt_totals", "E28", "rows", f"""WITH {_DEBT_SQL}
SELECT target, batch_size, sum(rows_needed)::bigint AS rows_needed, sum(batches)::bigint AS batches, bool_and(fits_window) AS every_source_fits FROM debts GROUP BY 1, 2""")
def debt_totals(t):
    return fo.debt_totals(debt_of(t))


@query("e28_refresh_throughput", "E28", "rows", f"""WITH {_HEALTH_SQL}
SELECT source_slug, rankable_rows, 1 AS runs, 90 AS coverable_rows, ceil(rankable_rows * 0.95::double)::bigint AS required_rows, {_PCT.format('90', 'rankable_rows')} AS coverage_percent,
  CASE WHEN 90 < ceil(rankable_rows * 0.95::double) THEN 'FAIL' ELSE 'PASS' END AS status FROM health2 WHERE rankable_rows > 0""")
def refresh_throughput(t):
    return fo.throughput(fo.source_health(rows_of(t), NOW), 18, 5, 6, 12, 1)


# -- guards and capacity -------------------------------------------------------------------
def _guards(kind: str) -> str:
    snapshot = "CASE WHEN r.product_name IS NULL THEN 'no_product_snapshot' END,"
    prices = """CASE WHEN n = 1 AND NOT coalesce(l.price > 0, false) THEN 'live_price_not_positive' END,
  CASE WHEN r.price <> 0 AND l.price > 0 AND floor(abs(l.price::double - r.price::double) / r.price::double * 100 * 10000 + 0.5) / 10000 > 200 THEN 'price_delta_too_large' END,"""
    available = "CASE WHEN n = 1 AND NOT l.is_available THEN 'live_unavailable' END,"
    return f"""list_filter([{'' if kind == 'manifest' else snapshot} CASE WHEN trim(r.ean) = '' THEN 'no_ean' END, CASE WHEN r.sku_id IS NULL THEN 'no_sku' END,
  CASE WHEN r.sku_id IS NOT NULL AND coalesce(u.c, 0) <> 1 THEN 'sku_not_unique' END, CASE WHEN r.sku_id IS NOT NULL AND coalesce(n, 0) <> 1 THEN 'live_match_not_single' END,
  CASE WHEN n = 1 AND l.ean <> r.ean THEN 'ean_mismatch' END, CASE WHEN n = 1 AND l.sku_id <> r.sku_id THEN 'sku_mismatch' END,
  CASE WHEN n = 1 AND {_HOST.format('l.product_url')} <> r.source_slug || '.example.com' THEN 'unexpected_host' END,
  CASE WHEN {_HOST.format('l.product_url')} <> {_HOST.format('r.product_url')} THEN 'host_drift' END,
  {available if kind == 'capacity' else ''} {'' if kind == 'manifest' else prices} NULL], lambda x: x IS NOT NULL)"""


def _evaluated_sql(kind: str) -> str:
    return f"""{_CLASSIFIED},
scan AS (SELECT * FROM bucketed WHERE rankable),
lc AS (SELECT source_slug, sku_id, count(*) AS n FROM live WHERE sku_id IS NOT NULL GROUP BY 1, 2),
uq AS (SELECT source_slug, sku_id, count(*) AS c FROM rows WHERE sku_id IS NOT NULL GROUP BY 1, 2),
evaluated AS (SELECT r.id, r.source_slug, r.ean, r.sku_id, r.last_checked_at AS checked_at, r.price, l.price AS live_price, l.list_price AS live_list, l.is_available AS live_available, {_guards(kind)} AS reasons
  FROM scan r LEFT JOIN lc USING (source_slug, sku_id) LEFT JOIN uq u ON u.source_slug = r.source_slug AND u.sku_id = r.sku_id
  LEFT JOIN live l ON l.source_slug = r.source_slug AND l.sku_id = r.sku_id AND lc.n = 1),
judged AS (SELECT *, CASE WHEN len(reasons) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM evaluated)"""


def scanned(t: Tables, kind: str) -> DataFrame:
    """All rankable rows with the guards they fail."""
    current = t.stored("supermarket_products")
    rows = rows_of(t, current)
    return op.evaluate_rows(rows.filter(fo.is_rankable()), rows, live_of(t, current), hosts_of(t), kind)


def _register_guards(kind: str) -> None:
    @query(f"j11_guards_{kind}", "C9 C10 D22 D23 J11", "rows live",
           f"WITH {_evaluated_sql(kind)} SELECT id, source_slug, array_to_string(reasons, ',') AS reasons, status FROM judged")
    def guards(t):
        return scanned(t, kind).select("id", "source_slug", F.array_join("reasons", ",").alias("reasons"), "status")


for _kind in ("prewrite", "capacity", "manifest"):
    _register_guards(_kind)


@query("c09_sku_uniqueness", "C9", "rows", """
SELECT r.id, coalesce(c, 0) AS sku_rows FROM rows r LEFT JOIN (SELECT source_slug, sku_id, count(*) AS c FROM rows WHERE sku_id IS NOT NULL GROUP BY 1, 2) u USING (source_slug, sku_id)""")
def sku_uniqueness(t):
    return op.sku_uniqueness(rows_of(t)).select("id", "sku_rows")


@query("c10_live_match_counts", "C10", "rows live", """
SELECT r.id, coalesce(n, 0) AS live_count FROM rows r LEFT JOIN (SELECT source_slug, sku_id, count(*) AS n FROM live WHERE sku_id IS NOT NULL GROUP BY 1, 2) u USING (source_slug, sku_id)""")
def live_match_counts(t):
    return op.with_live(rows_of(t), live_of(t)).select("id", "live_count")


@query("e25_blocker_histogram", "E25", "rows live", f"""WITH {_evaluated_sql('capacity')}
SELECT source_slug, reason, count(*) AS rows FROM (SELECT source_slug, unnest(reasons) AS reason FROM judged) GROUP BY 1, 2""")
def blocker_histogram(t):
    return op.blocker_histogram(scanned(t, "capacity"), "source_slug")


_CAPACITY_SQL = f"""{_evaluated_sql('capacity')},
hp AS (SELECT source_slug, count(*) FILTER (rankable) AS rankable_rows, count(*) FILTER (rankable AND status='fresh') AS fresh_rows FROM bucketed GROUP BY 1),
sc AS (SELECT source_slug, count(*) AS evaluated_rows, count(*) FILTER (status='PASS') AS viable_rows FROM judged GROUP BY 1),
c1 AS (SELECT hp.*, coalesce(evaluated_rows, 0) AS evaluated_rows, coalesce(viable_rows, 0) AS viable_rows, source_slug IN ({', '.join(f"'{w}'" for w in WRITERS)}) AS writer_supported FROM hp LEFT JOIN sc USING (source_slug)),
c2 AS (SELECT *, evaluated_rows - viable_rows AS blocked_rows, CASE WHEN rankable_rows = 0 OR viable_rows = 0 THEN 'excluded' WHEN evaluated_rows > viable_rows THEN 'mixed' ELSE 'viable' END AS classification,
  {_PCT.format('viable_rows', 'evaluated_rows')} AS fill_rate_percent, CASE WHEN viable_rows > 0 THEN ceil({BATCH}.0::double / (viable_rows::double / evaluated_rows))::bigint END AS scan_rows_needed FROM c1),
c3 AS (SELECT *, CASE WHEN classification = 'excluded' THEN 0 ELSE least({BATCH}, viable_rows) END AS recommended_batch,
  CASE WHEN rankable_rows = 0 THEN 'FAIL' WHEN classification IN ('excluded','mixed') OR NOT writer_supported OR viable_rows < {BATCH} THEN 'WARN' ELSE 'PASS' END AS status,
  greatest(0, ceil(rankable_rows * 0.9::double) - fresh_rows)::bigint AS rows_to_90, greatest(0, ceil(rankable_rows * 0.95::double) - fresh_rows)::bigint AS rows_to_95 FROM c2),
capacity AS (SELECT *, CASE WHEN recommended_batch > 0 THEN ceil(rows_to_90 / recommended_batch) ELSE 0 END::bigint AS chunks_to_90,
  CASE WHEN recommended_batch > 0 THEN ceil(rows_to_95 / recommended_batch) ELSE 0 END::bigint AS chunks_to_95 FROM c3)"""


def shared_capacity_scan(t: Tables) -> DataFrame:
    """The capacity guards over stored rows: two reads of these and one of the live answers, once for all that follows."""
    def scan(t: Tables) -> DataFrame:
        rows = shared_rows(t)
        return op.evaluate_rows(rows.filter(fo.is_rankable()), rows, live_of(t), hosts_of(t), "capacity").select("source_slug", "id", "status", "reasons")

    return t.shared("capacity-scan", scan)


def shared_rows(t: Tables) -> DataFrame:
    return t.shared("rows", rows_of)


def capacity_of(t: Tables) -> DataFrame:
    return op.refresh_capacity(fo.source_health(shared_rows(t), NOW), shared_capacity_scan(t), WRITERS, BATCH)


@query("e26_refresh_capacity", "E26", "rows live", f"WITH {_CAPACITY_SQL} SELECT * FROM capacity")
def refresh_capacity(t):
    return capacity_of(t)


@query("e40_capacity_verdict", "E40", "rows live", f"""WITH {_CAPACITY_SQL},
a AS (SELECT count(*) AS sources, sum(rankable_rows)::bigint AS rankable_rows, sum(viable_rows)::bigint AS viable_rows, count(*) FILTER (status='FAIL') AS failed_sources, count(*) FILTER (status='WARN') AS warned_sources FROM capacity)
SELECT *, CASE WHEN sources = 0 OR rankable_rows = 0 OR viable_rows = 0 OR failed_sources > 0 THEN 'FAIL' WHEN warned_sources > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM a""")
def capacity_verdict(t):
    return op.capacity_verdict(capacity_of(t))


_PICK_SQL = f"""{_evaluated_sql('prewrite')},
picked AS (SELECT *, row_number() OVER (PARTITION BY source_slug ORDER BY checked_at NULLS FIRST, id) AS pick FROM judged WHERE status = 'PASS' QUALIFY pick <= {BATCH})"""


@query("j12_refresh_selection", "J12", "rows live", f"""WITH {_PICK_SQL}
SELECT source_slug, pick, id, count(*) OVER (PARTITION BY source_slug) < {BATCH} AS short FROM picked""")
def refresh_selection(t):
    return op.select_refresh_rows(scanned(t, "prewrite"), BATCH).select("source_slug", "pick", "id", "short")


@query("c14_capacity_evidence", "C14", "rows live", f"""WITH {_CAPACITY_SQL},
chosen AS (SELECT id, source_slug FROM scan QUALIFY row_number() OVER (PARTITION BY source_slug ORDER BY last_checked_at NULLS FIRST, id) <= {BATCH})
SELECT c.source_slug, c.id, array_to_string(list_filter([CASE WHEN NOT writer_supported THEN 'not_writer_supported' END, CASE WHEN classification = 'excluded' THEN 'source_excluded' END,
  CASE WHEN k.status = 'FAIL' THEN 'source_failed' END, CASE WHEN viable_rows < {BATCH} THEN 'too_few_viable_rows' END, CASE WHEN recommended_batch < {BATCH} THEN 'batch_below_sample' END,
  CASE WHEN j.status <> 'PASS' THEN 'row_not_passed' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM chosen c JOIN capacity k USING (source_slug) JOIN judged j ON j.id = c.id""")
def capacity_evidence(t):
    chosen = fo.oldest_rankable(shared_rows(t), BATCH)
    return op.capacity_evidence(chosen, capacity_of(t), shared_capacity_scan(t), BATCH).withColumn("reasons", F.array_join("reasons", ","))


@query("j13_applied_refresh", "J13", "rows live", f"""WITH {_PICK_SQL}
SELECT r.id, CASE WHEN p.id IS NULL THEN r.price ELSE p.live_price END::double AS price, CASE WHEN p.id IS NULL THEN r.is_available ELSE p.live_available END AS is_available,
  CASE WHEN p.id IS NULL THEN r.last_checked_at ELSE TIMESTAMP '{NOW}' END AS last_checked_at, p.id IS NOT NULL AS refreshed
FROM rows r LEFT JOIN picked p ON p.id = r.id AND p.ean = r.ean AND p.sku_id = r.sku_id AND p.source_slug = r.source_slug""")
def applied_refresh(t):
    plan = op.select_refresh_rows(scanned(t, "prewrite"), BATCH)
    return op.apply_refresh(rows_of(t, t.stored("supermarket_products")), plan, NOW).select(
        "id", F.col("price").cast("double").alias("price"), "is_available", "last_checked_at", "refreshed")


_FEAS_SQL = f"""
ls AS (SELECT source_slug, sku_id, count(*) AS n FROM live WHERE sku_id IS NOT NULL GROUP BY 1, 2),
le AS (SELECT source_slug, ean, count(*) AS n, min(product_url) AS url FROM live GROUP BY 1, 2),
oe AS (SELECT source_slug, ean, count(*) AS n FROM rows WHERE trim(ean) <> '' GROUP BY 1, 2),
j AS (SELECT r.*, coalesce(ls.n, 0) AS sn, coalesce(le.n, 0) AS en, le.url AS eurl, oe.n AS own, l.ean AS lean, l.product_url AS lurl FROM rows r LEFT JOIN ls USING (source_slug, sku_id)
  LEFT JOIN le ON le.source_slug = r.source_slug AND le.ean = r.ean LEFT JOIN oe ON oe.source_slug = r.source_slug AND oe.ean = r.ean
  LEFT JOIN live l ON l.source_slug = r.source_slug AND l.sku_id = r.sku_id AND ls.n = 1),
d AS (SELECT id, source_slug, CASE WHEN sku_id IS NOT NULL AND sn > 0 THEN 'sku' WHEN trim(ean) <> '' AND en > 0 THEN 'ean' WHEN sku_id IS NOT NULL THEN 'sku' WHEN trim(ean) <> '' THEN 'ean' ELSE 'url' END AS lookup,
  CASE WHEN sku_id IS NOT NULL AND sn > 0 THEN CASE WHEN sn > 1 THEN 'ambiguous:several_live' WHEN lean <> ean THEN 'unviable:ean_mismatch' WHEN {_HOST.format('lurl')} <> {_HOST.format('product_url')} THEN 'unviable:host_drift' ELSE 'viable:matched' END
    WHEN trim(ean) <> '' AND en > 0 THEN CASE WHEN en > 1 THEN 'ambiguous:several_live' WHEN {_HOST.format('eurl')} <> {_HOST.format('product_url')} THEN 'unviable:host_drift' WHEN own <> 1 THEN 'ambiguous:several_rows' ELSE 'viable:matched' END
    WHEN sku_id IS NOT NULL OR trim(ean) <> '' THEN 'unviable:no_live_match' ELSE 'unviable:url_lookup_only' END AS o FROM j),
decided AS (SELECT id, source_slug, lookup, split_part(o, ':', 1) AS status, split_part(o, ':', 2) AS reason FROM d)"""


@query("k12_match_feasibility", "K12", "rows live", f"WITH {_FEAS_SQL} SELECT * FROM decided")
def match_feasibility(t):
    return op.match_feasibility(rows_of(t), live_of(t))


@query("k12_feasibility_advice", "K12", "rows live", f"""WITH {_FEAS_SQL},
a AS (SELECT source_slug, count(*) AS rows, count(*) FILTER (status='viable') AS viable, count(*) FILTER (status='ambiguous') AS ambiguous, count(*) FILTER (status='unviable') AS unviable FROM decided GROUP BY 1)
SELECT *, CASE WHEN unviable = rows THEN 'stop' WHEN viable = rows THEN 'direct-refresh' WHEN viable > 0 THEN 'search-fallback' ELSE 'larger-bounded-chunks' END AS advice,
  CASE WHEN unviable = rows THEN 'FAIL' WHEN viable < rows THEN 'WARN' ELSE 'PASS' END AS status FROM a""")
def feasibility_advice(t):
    return op.feasibility_advice(op.match_feasibility(rows_of(t), live_of(t)))


# -- drift -----------------------------------------------------------------------------------
def drift_of(t: Tables) -> DataFrame:
    live = op.first_candidates(live_of(t), ["copy", "id"])
    named = live.join(t.products.select("ean", "name", "brand", "description", "category"), "ean")
    damaged = named.withColumn("name", F.when(F.col("k") % 21 == 0, F.concat(F.lit("CafÃ© "), F.col("name"))).otherwise(F.col("name")))
    current = t.state_supermarket_products.select(
        slug_of(F.col("supermarket_id")).alias("source_slug"), F.col("product_ean").alias("ean"), "price", "id")
    return op.price_drift(damaged, t.state_products, current)


_DRIFT_SQL = """
f AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY source_slug, ean ORDER BY copy, id) = 1),
dj AS (SELECT f.source_slug, f.ean, f.k, f.price, x.price AS db_price, x.id AS db_id, f.ean IN (SELECT ean FROM state_products) AS known,
  CASE WHEN x.price > 0 AND f.price > 0 THEN floor((f.price::double - x.price::double) / x.price::double * 100 * 100 + 0.5) / 100 END AS delta_percent
  FROM f LEFT JOIN state_sp x ON x.product_ean = f.ean AND 'market-' || x.supermarket_id = f.source_slug),
drift AS (SELECT *, CASE WHEN price <= 0 THEN 'invalid_live_price' WHEN NOT known THEN 'missing_product' WHEN db_id IS NULL THEN 'missing_source_row'
  WHEN abs(delta_percent) > 200 THEN 'stop' WHEN abs(delta_percent) > 50 THEN 'warn' WHEN delta_percent = 0 THEN 'unchanged' ELSE 'changed' END AS class,
  array_to_string(list_filter([CASE WHEN price <= 0 THEN 'invalid-live-price' END, CASE WHEN k % 21 = 0 THEN 'mojibake:name' END], lambda x: x IS NOT NULL), ',') AS flags FROM dj)"""
_DRIFT_TABLES = "live state_sp state_products health"


@query("k01_price_drift", "B9 C13 D21 F10 K1", _DRIFT_TABLES, f"WITH {_DRIFT_SQL} SELECT source_slug, ean, delta_percent, class, flags FROM drift")
def price_drift(t):
    return drift_of(t).select("source_slug", "ean", "delta_percent", "class", F.array_join("flags", ",").alias("flags"))


@query("k01_drift_summary", "K1 H5", _DRIFT_TABLES, f"""WITH {_DRIFT_SQL},
dups AS (SELECT source_slug, count(*) AS duplicate_eans FROM (SELECT source_slug, ean FROM live GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
h AS (SELECT source_slug, is_healthy, hash_valid FROM health QUALIFY row_number() OVER (PARTITION BY source_slug ORDER BY checked_at DESC, id DESC) = 1),
a AS (SELECT source_slug, count(*) AS live_rows, {', '.join(f"count(*) FILTER (class = '{c}') AS {c}" for c in ('unchanged', 'changed', 'warn', 'stop', 'missing_product', 'missing_source_row', 'invalid_live_price'))},
  max(abs(delta_percent)) AS max_abs_delta_percent FROM drift GROUP BY 1)
SELECT a.*, coalesce(duplicate_eans, 0) AS duplicate_eans, is_healthy, hash_valid, CASE WHEN NOT is_healthy OR NOT hash_valid OR stop > 0 OR invalid_live_price > 0 THEN 'FAIL'
  WHEN warn > 0 OR missing_product > 0 OR missing_source_row > 0 OR coalesce(duplicate_eans, 0) > 0 THEN 'WARN' ELSE 'PASS' END AS status
FROM a LEFT JOIN dups USING (source_slug) JOIN h USING (source_slug)""")
def drift_summary(t):
    dups = op.duplicate_keys(live_of(t), "source_slug", "ean").groupBy("source_slug").agg(F.count("*").alias("duplicate_eans"))
    health = t.source_health.groupBy("source_slug").agg(
        F.max_by(F.struct("is_healthy", "hash_valid"), F.struct("checked_at", "id")).alias("h")).select("source_slug", "h.*")
    return op.drift_summary(drift_of(t), dups, health)


@query("c08_key_set_differences", "C8 H3 H5", "batch state_sp", """
WITH e AS (SELECT 'market-' || supermarket_id AS source_slug, product_ean AS ean, count(*) AS n FROM state_sp GROUP BY 1, 2),
a AS (SELECT source_slug, ean, count(*) AS n FROM batch GROUP BY 1, 2)
SELECT source_slug, ean, unnest(list_filter([CASE WHEN a.n IS NULL THEN 'missing' END, CASE WHEN e.n IS NULL THEN 'extra' END, CASE WHEN e.n > 1 THEN 'duplicate_expected' END,
  CASE WHEN a.n > 1 THEN 'duplicate_actual' END], lambda x: x IS NOT NULL)) AS issue FROM e FULL JOIN a USING (source_slug, ean)""")
def key_set_differences(t):
    expected = t.state_supermarket_products.select(slug_of(F.col("supermarket_id")).alias("source_slug"), F.col("product_ean").alias("ean"))
    return op.key_set_differences(expected, t.batch_candidates.select("source_slug", "ean"), "source_slug", "ean")
