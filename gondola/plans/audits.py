"""Change sets, discovery, post-write checks and operations roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BROKEN_TEXT_PATTERN
from ..operators import audits as op
from ..operators import discovery
from ..operators import refresh as rf
from ..operators import freshness as fo
from ..sources.derive import NOW, Tables, ean_of, slug_of
from .ingest import EVALUATED_SQL, UPSERT_SQL, BATCH_TABLES, evaluated, stored_winners, upserted, upserted_stored
from .refresh import _CAPACITY_SQL, WRITERS, capacity_of, hosts_of, live_of, rows_of, shared_rows
from .registry import DERIVED, query

# audit results of many operations, one per event
DERIVED["results"] = ((), """
  SELECT event_id AS id, event_id // 6 AS operation_id, ['source_health','freshness_baseline','manifest','prewrite','postwrite','active_write','no_partial','error'][event_id % 8 + 1] AS kind,
    'market-' || ((event_id // 6) % 6) AS source_slug, CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'click' THEN 'WARN' ELSE 'PASS' END AS status, ts AS generated_at,
    ['Transaction not found','Timed out fetching a new connection','request timeout','stale prewrite','row id mismatch','other'][cast(floor(value*10) AS bigint) % 6 + 1] AS message,
    CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END AS product_delta, CASE WHEN event_id % 41 = 0 THEN 2 ELSE 0 END AS row_delta, event_id % 53 = 0 AS closed FROM events""")
RESULTS_NOW = "2024-01-30 12:00:00"


def results_of(t: Tables) -> DataFrame:
    k = F.col("event_id")

    def pick(values, index):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))

    kinds = ("source_health", "freshness_baseline", "manifest", "prewrite", "postwrite", "active_write", "no_partial", "error")
    texts = ("Transaction not found", "Timed out fetching a new connection", "request timeout", "stale prewrite", "row id mismatch", "other")
    return t.raw("events").select(
        k.alias("id"), F.floor(k / 6).alias("operation_id"), pick(kinds, k % 8).alias("kind"), slug_of(F.floor(k / 6) % 6).alias("source_slug"),
        F.when(F.col("event_type") == "error", "FAIL").when(F.col("event_type") == "click", "WARN").otherwise("PASS").alias("status"),
        F.col("ts").cast("timestamp").alias("generated_at"), pick(texts, F.floor(F.col("value") * 10) % 6).alias("message"),
        F.when(k % 37 == 0, 1).otherwise(0).alias("product_delta"), F.when(k % 41 == 0, 2).otherwise(0).alias("row_delta"),
        F.when(k % 53 == 0, F.array(F.lit("closed"))).alias("fail_closed_reasons"))


# -- change set ------------------------------------------------------------------------------
@query("j10_change_set", "J10", "rows live", """
WITH lc AS (SELECT source_slug, sku_id, min(ean) AS ean, min(price) AS price, min(list_price) AS list_price, bool_and(is_available) AS is_available, min(product_url) AS url FROM live WHERE sku_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1),
j AS (SELECT r.id, unnest([{'field': 'price', 'before': r.price::decimal(18,4)::varchar, 'after': l.price::decimal(18,4)::varchar}, {'field': 'list_price', 'before': r.list_price::decimal(18,4)::varchar, 'after': l.list_price::decimal(18,4)::varchar},
  {'field': 'is_available', 'before': r.is_available::varchar, 'after': l.is_available::varchar}, {'field': 'product_url', 'before': r.product_url, 'after': l.url}]) AS c FROM rows r JOIN lc l USING (source_slug, sku_id))
SELECT id, c.field AS field, c.before AS before, c.after AS after FROM j WHERE c.before IS DISTINCT FROM c.after""")
def change_set(t):
    pairs = rf.with_live(rows_of(t), live_of(t)).filter(F.col("live").isNotNull())
    c = F.col
    return op.change_set(pairs, "id", {
        "price": op.number_pair(c("price"), c("live.price")), "list_price": op.number_pair(c("list_price"), c("live.list_price")),
        "is_available": (c("is_available"), c("live.is_available")), "product_url": (c("product_url"), c("live.url"))})


@query("j10_image_set_changes", "J10", "products", """
SELECT ean, 'images' AS field, array_to_string(list_sort(images), ',') AS before, array_to_string(list_sort(list_append(images, 'https://img.example.com/a.jpg')), ',') AS after FROM products WHERE partkey % 2 = 0""")
def image_set_changes(t):
    new = F.when(F.col("partkey") % 2 == 0, F.array_append("images", F.lit("https://img.example.com/a.jpg"))).otherwise(F.reverse("images"))
    return op.change_set(t.products, "ean", {"images": op.set_pair(F.col("images"), new)})


# -- candidate audit ---------------------------------------------------------------------------
def damaged(t: Tables) -> DataFrame:
    k = F.substring("ean", -3, 3).cast("int")
    return t.batch_candidates.withColumns({
        "name": F.when(k % 10 == 1, F.concat(F.lit("Ã "), "name")).otherwise(F.col("name")),
        "brand": F.when(k % 25 == 2, F.concat(F.lit("Â"), "brand")).otherwise(F.col("brand"))})


@query("b09_broken_text", "B9 K3", "batch", """
SELECT DISTINCT ean, field FROM (SELECT ean, unnest(list_filter([CASE WHEN right(ean, 3)::int % 10 = 1 THEN 'name' END, CASE WHEN right(ean, 3)::int % 25 = 2 AND brand IS NOT NULL THEN 'brand' END], lambda x: x IS NOT NULL)) AS field FROM batch)
WHERE NOT (field = 'name' AND right(ean, 2)::int = 11)""")
def broken_text(t):
    waivers = t.products.filter(F.substring("ean", -2, 2) == "11").select("ean", F.lit("name").alias("field"), F.lit("known").alias("reason"))
    return op.broken_text(damaged(t), waivers, BROKEN_TEXT_PATTERN)


@query("k03_existing_only_selection", "K3 G6", "batch state_products state_sp", """
WITH m AS (SELECT b.id, b.source_slug, b.ean, CASE WHEN b.ean NOT IN (SELECT ean FROM state_products) THEN 'missing_product'
  WHEN NOT EXISTS (SELECT 1 FROM state_sp x WHERE x.product_ean = b.ean AND 'market-' || x.supermarket_id = b.source_slug) THEN 'missing_store_row' END AS gap, created_at FROM batch b)
SELECT id, source_slug, coalesce(gap, CASE WHEN row_number() OVER (PARTITION BY source_slug, gap IS NULL ORDER BY created_at, id) <= 50 THEN 'selected' ELSE 'overflow' END) AS outcome FROM m""")
def existing_only_selection(t):
    current = t.state_supermarket_products.select(slug_of(F.col("supermarket_id")).alias("source_slug"), F.col("product_ean").alias("ean"))
    rows = op.existing_only_selection(t.batch_candidates.select("id", "source_slug", "ean", "created_at"), t.state_products, current, 50, ["created_at", "id"])
    return rows.select("id", "source_slug", "outcome")


@query("k03_candidate_checks", "K3", "batch", """
WITH b AS (SELECT source_slug, ean, count(*) AS n, count(*) FILTER (price <= 0) AS p, bool_or(right(ean, 3)::int % 10 = 1 OR (right(ean, 3)::int % 25 = 2 AND brand IS NOT NULL)) AS bad FROM batch GROUP BY 1, 2),
a AS (SELECT source_slug, sum(n)::bigint AS rows, count(*) AS eans, sum(p)::bigint AS bad_prices, count(*) FILTER (bad) AS broken_eans FROM b GROUP BY 1)
SELECT *, array_to_string(list_filter([CASE WHEN rows <> 9000 OR eans <> 9000 THEN 'count_differs' END, CASE WHEN bad_prices > 0 THEN 'price_not_positive' END, CASE WHEN broken_eans > 0 THEN 'broken_text' END], lambda x: x IS NOT NULL), ',') AS reasons FROM a""")
def candidate_checks(t):
    rows = damaged(t)
    none = t.products.filter(F.lit(False)).select("ean", F.lit("name").alias("field"), F.lit("x").alias("reason"))
    return op.candidate_checks(rows, 9000, op.broken_text(rows, none, BROKEN_TEXT_PATTERN)).withColumn("reasons", F.array_join("reasons", ","))


# -- batches -------------------------------------------------------------------------------------
@query("k17_pre_reconcile_gate", "K17", "staging observations", f"""WITH {EVALUATED_SQL},
c AS (SELECT * FROM evaluated), e AS (SELECT l_orderkey AS batch_id, lpad(l_partkey::varchar, 13, '0') AS ean FROM lineitem WHERE l_linenumber <> 4),
ee AS (SELECT batch_id, ean, count(*) AS en FROM e GROUP BY 1, 2),
aa AS (SELECT run_id AS batch_id, ean, count(*) AS an, count(*) FILTER (status = 'REJECTED') AS rej, count(*) FILTER (status <> 'PENDING') AS np, count(*) FILTER (price <= 0) AS bp, min(source_slug) AS s0, max(source_slug) AS s1 FROM c GROUP BY 1, 2),
g AS (SELECT batch_id, coalesce(sum(en), 0) AS er, coalesce(sum(an), 0) AS ar, count(an) AS ae, count(*) FILTER (en > 1) AS de, count(*) FILTER (an IS NULL OR en IS NULL) AS sd, sum(rej) AS rej, sum(np) AS np, sum(bp) AS bp, min(s0) AS s0, max(s1) AS s1
  FROM ee FULL JOIN aa USING (batch_id, ean) GROUP BY 1),
r AS (SELECT batch_id, list_filter([CASE WHEN er = 0 THEN 'nothing_expected' END, CASE WHEN de > 0 THEN 'expected_not_distinct' END, CASE WHEN s0 IS NULL OR s0 <> s1 THEN 'not_one_source' END, CASE WHEN batch_id % 3 <> 1 THEN 'query_count' END,
  CASE WHEN batch_id % 7 = 0 THEN 'fingerprint' END, CASE WHEN rej > 0 THEN 'rejected_rows' END, CASE WHEN ar <> er THEN 'row_count' END, CASE WHEN ae <> er THEN 'distinct_count' END, CASE WHEN np > 0 THEN 'not_pending' END, CASE WHEN bp > 0 THEN 'price_not_positive' END, CASE WHEN sd > 0 THEN 'ean_set' END], lambda x: x IS NOT NULL) AS reasons FROM g)
SELECT batch_id, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r""")
def pre_reconcile_gate(t):
    expected = t.raw("lineitem").filter("l_linenumber <> 4").select(F.col("l_orderkey").alias("batch_id"), ean_of(F.col("l_partkey")).alias("ean"))
    rows = evaluated(t).select(F.col("run_id").alias("batch_id"), "source_slug", "ean", "price", "status")
    sent = t.raw("orders").select(F.col("o_orderkey").alias("batch_id"), (F.col("o_orderkey") % 3).alias("queries_sent"))
    k = F.col("o_orderkey")
    plan = F.concat(F.lit("plan-"), (k % 5).cast("string"))
    prints = t.raw("orders").select(k.alias("batch_id"), plan.alias("expected"), F.when(k % 7 == 0, "another").otherwise(plan).alias("actual"))
    return op.pre_reconcile_gate(expected, rows, sent, fingerprints=prints).withColumn("reasons", F.array_join("reasons", ","))


@query("e35_run_aggregate", "E35", "runs", """
WITH ch AS (SELECT batch_id, id AS chunk_id, source_slug, CASE WHEN id % 50 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN id % 61 = 0 THEN 'pre-write' ELSE 'post-write' END AS phase,
  CASE WHEN id % 71 <> 0 THEN 'refresh-existing' END AS mode, CASE WHEN id % 43 = 0 THEN NULL ELSE (id % 97 = 0)::int END AS np, 0 AS cr FROM runs),
b AS (SELECT batch_id, count(*) AS chunks, count(*) FILTER (status <> 'PASS' OR phase <> 'post-write') AS bad, count(*) FILTER (mode IS NULL) AS om, count(*) FILTER (np IS NULL) AS ne, count(DISTINCT source_slug) AS s, sum(np)::bigint AS np, sum(cr)::bigint AS cr FROM ch GROUP BY 1),
tt AS (SELECT r.batch_id, l_partkey, count(*) AS n FROM lineitem JOIN runs r ON r.id = l_orderkey GROUP BY 1, 2), te AS (SELECT batch_id, sum(n)::bigint AS touched, count(*) FILTER (n > 1) AS rep FROM tt GROUP BY 1),
r AS (SELECT batch_id, chunks, coalesce(touched, 0) AS touched_eans, np AS new_products, cr AS created_rows, list_filter([CASE WHEN bad > 0 THEN 'chunk_not_passed' END, CASE WHEN om > 0 THEN 'write_mode' END, CASE WHEN ne > 0 THEN 'evidence_missing' END,
  CASE WHEN s <> 1 THEN 'mixed_sources' END, CASE WHEN rep > 0 THEN 'repeated_eans' END, CASE WHEN np > 0 OR cr > 0 THEN 'created_rows' END], lambda x: x IS NOT NULL) AS reasons FROM b LEFT JOIN te USING (batch_id))
SELECT * REPLACE (array_to_string(reasons, ',') AS reasons), CASE WHEN len(reasons) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r""")
def run_aggregate(t):
    k = F.col("id")
    chunks = t.ingestion_run.select(
        "batch_id", k.alias("chunk_id"), "source_slug", F.when(k % 50 == 0, "FAIL").otherwise("PASS").alias("status"),
        F.when(k % 61 == 0, "pre-write").otherwise("post-write").alias("phase"), F.when(k % 71 != 0, "refresh-existing").alias("write_mode"),
        F.when(k % 43 != 0, (k % 97 == 0).cast("int")).alias("new_products"), F.lit(0).alias("created_rows"))
    touched = t.raw("lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("ean")).join(
        chunks.select("batch_id", "chunk_id"), "chunk_id")
    return op.run_aggregate(chunks, touched).withColumn("reasons", F.array_join("reasons", ","))


@query("k04_post_run_audit", "K4", BATCH_TABLES, f"""WITH {UPSERT_SQL},
act AS (SELECT product_ean, supermarket_id, CASE WHEN right(product_ean, 2) = '07' THEN price + 1 ELSE price END AS price, CASE WHEN right(product_ean, 2) = '09' THEN NOT is_available ELSE is_available END AS is_available, sku_id FROM upserted WHERE right(product_ean, 3) <> '005'),
j AS (SELECT w.ean AS product_ean, w.supermarket_id, list_filter([CASE WHEN a.product_ean IS NULL THEN 'missing' END, CASE WHEN a.price IS DISTINCT FROM w.price::double AND a.product_ean IS NOT NULL THEN 'price_differs' END,
   CASE WHEN a.is_available <> w.is_available THEN 'is_available_differs' END, CASE WHEN abs(floor((w.price::double - o.price::double) / o.price::double * 100 * 100 + 0.5) / 100) > 8 THEN 'price_change_stop' END], lambda x: x IS NOT NULL) AS reasons,
   coalesce(abs(floor((w.price::double - o.price::double) / o.price::double * 100 * 100 + 0.5) / 100) > 4, false) AS lc
  FROM winners w LEFT JOIN act a ON a.product_ean = w.ean AND a.supermarket_id = w.supermarket_id LEFT JOIN state_sp o ON o.product_ean = w.ean AND o.supermarket_id = w.supermarket_id)
SELECT product_ean, supermarket_id, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) > 0 THEN 'FAIL' WHEN lc THEN 'WARN' ELSE 'PASS' END AS status FROM j""")
def post_run_audit(t):
    end = F.substring("product_ean", -2, 2)
    rows = stored_winners(t).join(
        t.supermarkets.select(F.col("slug").alias("source_slug"), F.col("id").alias("supermarket_id")), "source_slug").withColumnRenamed("ean", "product_ean")
    actual = upserted_stored(t).filter(F.substring("product_ean", -3, 3) != "005").withColumns({
        "price": F.when(end == "07", F.col("price") + 1).otherwise(F.col("price")).cast("decimal(10,2)"),
        "is_available": F.when(end == "09", ~F.col("is_available")).otherwise(F.col("is_available"))})
    rows = op.post_run_audit(rows, actual, t.stored("state_supermarket_products"), warn=4.0, stop=8.0)
    return rows.withColumn("reasons", F.array_join("reasons", ","))


@query("k05_rollback_equality", "K5 H3", BATCH_TABLES, f"""WITH {UPSERT_SQL},
a AS (SELECT product_ean, supermarket_id, price::double AS price, is_available FROM state_sp), b AS (SELECT product_ean, supermarket_id, price, is_available FROM upserted WHERE action <> 'insert')
SELECT (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS only_in_snapshot, (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS only_in_restored,
  CASE WHEN EXISTS (FROM a EXCEPT ALL FROM b) OR EXISTS (FROM b EXCEPT ALL FROM a) THEN 'FAIL' ELSE 'PASS' END AS status""")
def rollback_equality(t):
    columns = ["product_ean", "supermarket_id", "price", "is_available"]
    return op.rollback_equality(t.state_supermarket_products.select(*columns), upserted(t).filter("action <> 'insert'").select(*columns))


# -- post-write ------------------------------------------------------------------------------------
@query("k10_post_write_audit", "K10", "rows sp observations", """
WITH p AS (SELECT id, ean, sku_id, price, is_available FROM rows), c AS (SELECT id, product_ean AS ean, sku_id, price, is_available FROM sp WHERE last_checked_at < TIMESTAMP '2001-10-01'),
r AS (SELECT p.id, unnest(list_filter([CASE WHEN c.id IS NULL THEN 'row_missing' END, CASE WHEN c.ean <> p.ean THEN 'ean_differs' END, CASE WHEN c.id IS NOT NULL AND c.price IS DISTINCT FROM p.price THEN 'price_differs' END], lambda x: x IS NOT NULL)) AS reason FROM p LEFT JOIN c USING (id)),
h AS (SELECT coalesce(e.sid, a.sid) AS id, unnest(list_filter([CASE WHEN a.hid IS NULL THEN 'history_missing' END, CASE WHEN e.hid IS NULL THEN 'history_unexpected' END, CASE WHEN e.price <> a.price THEN 'history_price_differs' END], lambda x: x IS NOT NULL)) AS reason
  FROM (SELECT id AS hid, supermarket_product_id AS sid, price FROM observations WHERE scraped_at >= TIMESTAMP '1995-03-01') e FULL JOIN (SELECT id AS hid, supermarket_product_id AS sid, CASE WHEN orderkey % 60 = 1 THEN price + 1 ELSE price END AS price FROM observations WHERE scraped_at < TIMESTAMP '2001-09-01') a USING (hid))
SELECT DISTINCT * FROM (FROM r UNION ALL FROM h)""")
def post_write_audit(t):
    plan = rows_of(t).select("id", "ean", "sku_id", "price", "is_available")
    current = t.supermarket_products.filter(F.col("last_checked_at") < F.lit("2001-10-01").cast("timestamp")).select("id", F.col("product_ean").alias("ean"), "sku_id", "price", "is_available")
    o = t.observations
    rows = lambda keep, price: o.filter(keep).select(
        F.col("id").alias("history_id"), F.col("supermarket_product_id").alias("id"), price.cast("decimal(10,2)").alias("price"))
    expected = rows(F.col("scraped_at") >= F.lit("1995-03-01").cast("timestamp"), F.col("price"))
    actual = rows(F.col("scraped_at") < F.lit("2001-09-01").cast("timestamp"), F.when(F.col("orderkey") % 60 == 1, F.col("price") + 1).otherwise(F.col("price")))
    return op.post_write_audit(plan, current, expected, actual)


# -- discovery --------------------------------------------------------------------------------------
DERIVED["found"] = (("live", "products"), """
  SELECT l.source_slug, l.ean, l.sku_id, l.product_url, l.price, l.list_price, l.is_available, CASE WHEN k % 21 = 0 THEN 'Ãƒ ' || p.name ELSE p.name END AS name, p.brand, p.description, p.image_url, p.category
  FROM (SELECT * FROM live WHERE copy = 0) l JOIN products p USING (ean)""")
_DISC_SQL = """
cur AS (SELECT 'market-' || supermarket_id AS source_slug, product_ean AS ean, sku_id FROM state_sp),
pend AS (SELECT DISTINCT source_slug, ean FROM batch WHERE created_at >= TIMESTAMP '2001-09-01'),
sk AS (SELECT source_slug, sku_id, count(*) AS n FROM cur WHERE sku_id IS NOT NULL GROUP BY 1, 2),
a0 AS (SELECT f.*, f.ean IN (SELECT ean FROM state_products) AS has_product, EXISTS (SELECT 1 FROM cur c WHERE c.source_slug = f.source_slug AND c.ean = f.ean) AS has_row,
  list_filter([CASE WHEN f.sku_id IS NULL THEN 'no_sku' END, CASE WHEN contains(name, 'Ãƒ') THEN 'broken_text' END, CASE WHEN price <= 0 THEN 'price_not_positive' END, CASE WHEN NOT is_available THEN 'unavailable' END,
    CASE WHEN EXISTS (SELECT 1 FROM pend w WHERE w.source_slug = f.source_slug AND w.ean = f.ean) THEN 'pending_staging_row' END, CASE WHEN sk.n > 0 THEN 'sku_in_use' END], lambda x: x IS NOT NULL) AS b
  FROM found f LEFT JOIN sk ON sk.source_slug = f.source_slug AND sk.sku_id = f.sku_id),
audit AS (SELECT *, CASE WHEN has_row THEN 'already-covered' WHEN len(b) > 0 THEN 'blocked' WHEN has_product THEN 'source-row-discovery' ELSE 'product-and-source-discovery' END AS classification,
  CASE WHEN has_row THEN 'source_row_exists' ELSE array_to_string(b, ',') END AS blockers, 'discovery:' || source_slug || ':' || ean || ':' || coalesce(sku_id, 'no-sku') AS idempotency_key FROM a0)"""
_DISC_TABLES = "found state_sp state_products batch"


def audit_of(t: Tables) -> DataFrame:
    live = live_of(t, t.stored("supermarket_products")).filter("copy = 0").drop("copy", "id").join(
        t.products.select("ean", "name", "brand", "description", "image_url", "category"), "ean").withColumn(
        "name", F.when(F.col("k") % 21 == 0, F.concat(F.lit("Ãƒ "), "name")).otherwise(F.col("name")))
    return discovery.discovery_audit(live, t.state_products, _current(t), _pending(t), hosts_of(t))


def _current(t: Tables) -> DataFrame:
    return t.stored("state_supermarket_products").select(slug_of(F.col("supermarket_id")).alias("source_slug"), F.col("product_ean").alias("ean"), "sku_id")


def _pending(t: Tables) -> DataFrame:
    def waiting(t: Tables) -> DataFrame:
        return t.batch_candidates.filter(F.col("created_at") >= F.lit("2001-09-01").cast("timestamp")).select("source_slug", "ean")

    return t.shared("pending", waiting)


@query("k08_discovery_audit", "K8 D27", _DISC_TABLES, f"WITH {_DISC_SQL} SELECT source_slug, ean, classification, blockers, idempotency_key FROM audit")
def discovery_audit(t):
    return audit_of(t).select("source_slug", "ean", "classification", F.array_join("blockers", ",").alias("blockers"), "idempotency_key")


@query("k08_discovery_summary", "K8", _DISC_TABLES, f"""WITH {_DISC_SQL},
s AS (SELECT source_slug, count(*) AS scanned, count(*) FILTER (classification LIKE '%discovery') AS selected, count(*) FILTER (classification = 'product-and-source-discovery') AS product_creates,
  count(*) FILTER (classification NOT LIKE '%discovery') AS blocked FROM audit GROUP BY 1) SELECT *, CASE WHEN selected > 0 THEN 'PASS' ELSE 'WARN' END AS status FROM s""")
def discovery_summary(t):
    return discovery.discovery_summary(audit_of(t))


_PLAN_SQL = f"""{_DISC_SQL},
pp AS (SELECT ean, arg_min(idempotency_key, (source_slug, idempotency_key)) AS idempotency_key FROM audit WHERE classification = 'product-and-source-discovery' GROUP BY 1),
pr AS (SELECT * FROM audit WHERE classification LIKE '%discovery')"""


@query("j14_discovery_plan", "J14", _DISC_TABLES, f"""WITH {_PLAN_SQL}
SELECT 'products' AS "table", idempotency_key, ean, NULL::double AS price FROM pp UNION ALL SELECT 'supermarket_products', idempotency_key, ean, price::double FROM pr
UNION ALL SELECT 'price_history', idempotency_key, ean, price::double FROM pr""")
def discovery_plan(t):
    plans = _created(t)
    part = lambda name, price: plans[name].select(F.lit(name).alias("table"), "idempotency_key", "ean", price.cast("double").alias("price"))
    return part("products", F.lit(None)).unionByName(part("supermarket_products", F.col("price"))).unionByName(part("price_history", F.col("price")))


@query("j14_apply_races", "J14", _DISC_TABLES + " sp", f"""WITH {_PLAN_SQL},
c2 AS (SELECT 'market-' || supermarket_id AS source_slug, product_ean AS ean, sku_id FROM sp WHERE last_checked_at >= TIMESTAMP '2001-06-01')
SELECT idempotency_key, source_slug, ean, array_to_string(list_filter([CASE WHEN classification = 'product-and-source-discovery' AND category IS NOT NULL THEN 'product_exists' END,
  CASE WHEN classification = 'source-row-discovery' AND category IS NULL THEN 'product_missing' END,
  CASE WHEN EXISTS (SELECT 1 FROM c2 WHERE c2.source_slug = pr.source_slug AND c2.ean = pr.ean) THEN 'source_row_exists' END,
  CASE WHEN EXISTS (SELECT 1 FROM c2 WHERE c2.source_slug = pr.source_slug AND c2.sku_id = pr.sku_id) THEN 'sku_in_use' END], lambda x: x IS NOT NULL), ',') AS reasons FROM pr""")
def apply_races(t):
    plan = _created(t)["supermarket_products"]
    later = t.stored("supermarket_products").filter(F.col("last_checked_at") >= F.lit("2001-06-01").cast("timestamp")).select(
        slug_of(F.col("supermarket_id")).alias("source_slug"), F.col("product_ean").alias("ean"), "sku_id")
    some = t.products.filter(F.col("category").isNotNull())
    return discovery.apply_races(plan, some, later, _pending(t)).withColumn("reasons", F.array_join("reasons", ","))


_RB_KEYS = {"price_history": ["source_slug", "ean"], "supermarket_products": ["source_slug", "ean"], "products": ["ean"]}


def _created(t: Tables) -> dict[str, DataFrame]:
    """The insert plans over the audit as the artifact it is: written once, then read by each table's plan."""
    return discovery.planned_creates(t.shared("discovery-audit", audit_of), NOW)


def _rollback_inputs(t: Tables):
    plans = _created(t)
    ordered = {n: plans[n] for n in _RB_KEYS}  # children first
    rows = t.stored("supermarket_products").select(slug_of(F.col("supermarket_id")).alias("source_slug"), F.col("product_ean").alias("ean"), "id")
    before = {"price_history": rows, "supermarket_products": rows, "products": t.products.select("ean")}
    return ordered, before


@query("j15_rollback_report", "J15", _DISC_TABLES + " sp", f"""WITH {_PLAN_SQL}, n AS (SELECT (SELECT count(*) FROM pr) AS r, (SELECT count(*) FROM pp) AS p)
SELECT 'price_history' AS "table", r AS planned, r AS present, (SELECT count(*) FROM pr WHERE right(ean, 2) = '13') AS remaining, r - (SELECT count(*) FROM pr WHERE right(ean, 2) = '13') AS deleted,
  CASE WHEN (SELECT count(*) FROM pr WHERE right(ean, 2) = '13') > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM n
UNION ALL SELECT 'supermarket_products', r, r, 0, r, 'PASS' FROM n UNION ALL SELECT 'products', p, p, 0, p, 'PASS' FROM n""")
def rollback_report(t):
    plans, before = _rollback_inputs(t)
    after = discovery.rollback_tables(plans, before, _RB_KEYS)
    after["price_history"] = after["price_history"].unionByName(before["price_history"].filter(F.substring("ean", -2, 2) == "13"))
    return discovery.rollback_report(plans, before, after, _RB_KEYS)


@query("k11_created_row_audit", "K11", _DISC_TABLES, f"""WITH {_PLAN_SQL},
a AS (SELECT source_slug, ean, CASE WHEN right(ean, 2) = '17' THEN price + 1 ELSE price END AS price, sku_id FROM pr WHERE right(ean, 2) <> '19' UNION ALL SELECT 'market-x', ean, NULL, NULL FROM pp)
SELECT source_slug, ean, CASE WHEN a.price IS NULL AND source_slug <> 'market-x' THEN 'missing' WHEN source_slug = 'market-x' THEN 'unexpected' WHEN a.price <> p.price THEN 'price_differs' ELSE '' END AS reasons
FROM pr p FULL JOIN a USING (source_slug, ean)""")
def created_row_audit(t):
    plans = _created(t)
    plan, end = plans["supermarket_products"], F.substring("ean", -2, 2)
    actual = plan.filter(end != "19").select(
        "source_slug", "ean", F.when(end == "17", F.col("price") + 1).otherwise(F.col("price")).cast("decimal(10,2)").alias("price"), "sku_id")
    extra = plans["products"].select(F.lit("market-x").alias("source_slug"), "ean", F.lit(None).cast("decimal(10,2)").alias("price"), F.lit(None).cast("string").alias("sku_id"))
    rows = discovery.created_row_audit(plan, actual.unionByName(extra), ["source_slug", "ean"], ["price", "sku_id"])
    return rows.withColumn("reasons", F.array_join("reasons", ","))


# -- health, alerts, controls --------------------------------------------------------------------------
@query("k13_source_health", "K13", "rows live supermarkets", f"""WITH {_CAPACITY_SQL},
hs AS (SELECT source_slug, CASE WHEN rankable_rows = 0 THEN 'FAIL' WHEN floor(fresh_rows::double / rankable_rows * 100 * 100 + 0.5)/100 < 95 THEN 'WARN' ELSE 'PASS' END AS fs FROM hp),
e AS (SELECT 'market-' || i AS source_slug FROM range(7) t(i)),
j AS (SELECT e.source_slug, s.slug IS NOT NULL AS ex, s.is_active, s.id % 4 <> 3 AS vtex, CASE WHEN s.id <> 2 THEN s.base_url END AS base_url, fs, c.status AS cs, classification, blocked_rows, scan_rows_needed, c.source_slug IS NOT NULL AS hc
  FROM e LEFT JOIN supermarkets s ON s.slug = e.source_slug LEFT JOIN hs USING (source_slug) LEFT JOIN capacity c ON c.source_slug = e.source_slug),
r AS (SELECT source_slug, list_filter([CASE WHEN NOT ex THEN 'record_missing' END, CASE WHEN ex AND NOT is_active THEN 'inactive' END, CASE WHEN ex AND NOT vtex THEN 'platform_unsupported' END, CASE WHEN base_url IS NULL THEN 'base_url_invalid' END,
   CASE WHEN base_url IS NOT NULL AND source_slug = 'market-1' THEN 'base_url_host' END, CASE WHEN coalesce(fs, 'FAIL') = 'FAIL' THEN 'freshness_failed' END, CASE WHEN cs = 'FAIL' THEN 'capacity_failed' END], lambda x: x IS NOT NULL) AS f,
  list_filter([CASE WHEN source_slug NOT IN ('market-0','market-1','market-2','market-3') THEN 'audit_only' END, CASE WHEN fs = 'WARN' THEN 'freshness_below_target' END, CASE WHEN NOT hc THEN 'capacity_not_provided' END, CASE WHEN coalesce(cs, 'WARN') = 'WARN' THEN 'capacity_warning' END,
   CASE WHEN classification = 'mixed' THEN 'capacity_mixed' END, CASE WHEN blocked_rows > 0 THEN 'blocked_rows' END, CASE WHEN source_slug = 'market-0' AND scan_rows_needed >= 30 THEN 'rapid_confirmation' END], lambda x: x IS NOT NULL) AS w FROM j)
SELECT source_slug, array_to_string(list_sort(list_concat(f, w)), ',') AS reasons, CASE WHEN len(f) > 0 THEN 'FAIL' WHEN len(w) > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM r""")
def source_health(t):
    s = t.supermarkets.withColumns({"is_vtex": F.col("id") % 4 != 3, "base_url": F.when(F.col("id") != 2, F.col("base_url"))})
    hosts = hosts_of(t).withColumn("expected_host", F.when(F.col("source_slug") == "market-1", "elsewhere.example.com").otherwise(F.col("expected_host")))
    planned = t.supermarkets.filter("id = 0").select(F.lit("market-6").alias("source_slug"), F.lit("market-6.example.com").alias("expected_host"))
    rows = op.source_health_verdicts(s, fo.source_health(shared_rows(t), NOW), capacity_of(t), hosts.unionByName(planned), WRITERS, ["market-0"], 30)
    return rows.withColumn("reasons", F.array_join("reasons", ","))


_ALERT_SQL = f"""
tx AS (SELECT *, lower(message) AS m, product_delta <> 0 OR row_delta <> 0 AS made FROM results),
cond AS (SELECT id, source_slug, unnest(list_filter([CASE WHEN kind = 'source_health' AND status = 'FAIL' THEN 'source_health_fail' END, CASE WHEN kind = 'source_health' AND status = 'WARN' THEN 'source_health_warn' END,
  CASE WHEN kind = 'freshness_baseline' AND status = 'FAIL' THEN 'freshness_baseline_fail' END, CASE WHEN kind = 'freshness_baseline' AND status = 'WARN' THEN 'freshness_baseline_warn' END,
  CASE WHEN kind = 'manifest' AND status = 'FAIL' THEN 'manifest_fail' END, CASE WHEN kind = 'prewrite' AND status = 'FAIL' THEN 'prewrite_fail' END, CASE WHEN kind = 'postwrite' AND status = 'FAIL' THEN 'postwrite_fail' END,
  CASE WHEN kind = 'no_partial' AND status = 'FAIL' THEN 'no_partial_verification_fail' END, CASE WHEN kind IN ('postwrite','active_write') AND made THEN 'no_create_invariant_violation' END,
  CASE WHEN kind = 'error' AND m LIKE 'transaction not found%' THEN 'prisma_transaction_not_found' END, CASE WHEN kind = 'error' AND m LIKE 'timed out fetching%' THEN 'prisma_pool_exhaustion' END,
  CASE WHEN kind = 'error' AND m LIKE '%timeout' THEN 'active_writer_timeout' END,
  CASE WHEN (kind = 'prewrite' AND TIMESTAMP '2024-01-30 12:00:00' - generated_at > INTERVAL 15 MINUTE) OR (kind = 'error' AND m = 'stale prewrite') THEN 'prewrite_stale' END,
  CASE WHEN kind = 'error' AND m LIKE '%mismatch' THEN 'confirmation_mismatch' END], lambda x: x IS NOT NULL)) AS condition FROM tx),
policy(condition, severity, owner) AS (VALUES {', '.join(f"('{c}', '{s}', '{o}')" for c, s, o in op.ALERT_POLICY)})"""


@query("k14_alerts", "K14", "results", f"WITH {_ALERT_SQL} SELECT id, source_slug, condition, severity, owner FROM cond JOIN policy USING (condition)")
def alerts(t):
    return op.classify_alerts(results_of(t), RESULTS_NOW).select("id", "source_slug", "condition", "severity", "owner")


@query("k14_missing_artifacts", "K14", "results", """
WITH w AS (SELECT DISTINCT operation_id, k.kind, k.condition, k.severity FROM results, (VALUES ('postwrite', 'missing_postwrite_artifact', 'HIGH'), ('freshness_baseline', 'missing_baseline_artifact', 'HIGH')) k(kind, condition, severity))
SELECT operation_id, kind, condition, severity FROM w WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.operation_id = w.operation_id AND r.kind = w.kind)""")
def missing_artifacts(t):
    results = results_of(t)
    rows = op.missing_artifacts(results.select("operation_id").distinct(), results,
                                {"postwrite": "missing_postwrite_artifact", "freshness_baseline": "missing_baseline_artifact"})
    return rows.select("operation_id", "kind", "condition", "severity")


_STOP_SQL = f"""
ctl AS (SELECT id, CASE WHEN id % 40 = 0 THEN 'global' ELSE 'source' END AS scope, CASE WHEN id % 40 <> 0 THEN 'market-' || (id % 7) END AS source, CASE WHEN id % 90 <> 1 THEN is_active AND id % 3 = 0 END AS stop,
  conditions AS reason, 'ops' AS owner, end_date AS expires_at FROM promotions),
st AS (SELECT id, scope, source, CASE WHEN scope = 'source' AND source NOT IN (SELECT slug FROM supermarkets) THEN 'invalid' WHEN stop IS NULL THEN 'invalid'
  WHEN stop AND NOT coalesce(expires_at <= TIMESTAMP '{NOW}', false) THEN CASE WHEN reason IS NULL THEN 'active_incomplete' ELSE 'active' END
  WHEN coalesce(expires_at <= TIMESTAMP '{NOW}', false) THEN 'expired' ELSE 'inactive' END AS state FROM ctl)"""


def states_of(t: Tables) -> DataFrame:
    k = F.col("id")
    controls = t.promotions.select(
        "id", F.when(k % 40 == 0, "global").otherwise("source").alias("scope"), F.when(k % 40 != 0, slug_of(k % 7)).alias("source"),
        F.when(k % 90 != 1, F.col("is_active") & (k % 3 == 0)).alias("stop"), F.col("conditions").alias("reason"), F.lit("ops").alias("owner"),
        F.col("end_date").alias("expires_at"))
    return op.stop_controls(controls, t.supermarkets, NOW)


@query("k15_stop_controls", "K15", "promotions supermarkets", f"WITH {_STOP_SQL} SELECT * FROM st")
def stop_controls(t):
    return states_of(t)


@query("k15_stop_status", "K15", "promotions supermarkets", f"""WITH {_STOP_SQL}, x AS (SELECT *, state LIKE 'active%' AS on_ FROM st),
g AS (SELECT count(*) FILTER (scope = 'global' AND on_) AS gs, count(*) FILTER (state IN ('invalid', 'active_incomplete')) AS ic FROM x)
SELECT s.slug, (SELECT count(*) FROM x WHERE scope = 'source' AND source = s.slug AND on_) AS own_stops, gs AS global_stops, ic AS invalid_controls,
  CASE WHEN (SELECT count(*) FROM x WHERE scope = 'source' AND source = s.slug AND on_) + gs + ic > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM supermarkets s, g""")
def stop_status(t):
    return op.stop_status(states_of(t), t.supermarkets)


_LEDGER = """led AS (SELECT event_id AS id, user_id AS run_key, 'market-' || (user_id % 6) AS source_slug, ts AS at_time,
  CASE event_type WHEN 'view' THEN 'PLANNED' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'signup' THEN 'STOPPED' ELSE 'FAILED' END AS status FROM events)"""


def ledger_of(t: Tables) -> DataFrame:
    e = F.col("event_type")
    status = (F.when(e == "view", "PLANNED").when(e == "click", "RUNNING").when(e == "purchase", "COMPLETED").when(e == "signup", "STOPPED").otherwise("FAILED"))
    return t.raw("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("run_key"), slug_of(F.col("user_id") % 6).alias("source_slug"),
                                  F.col("ts").cast("timestamp").alias("at"), status.alias("status"))


@query("k16_ledger_transitions", "K16", "", f"""WITH {_LEDGER}, s AS (SELECT *, lag(status) OVER (PARTITION BY run_key ORDER BY at_time, id) AS previous FROM led)
SELECT id, run_key, previous, status, CASE WHEN previous IS NULL THEN 'first' WHEN previous NOT IN ('PLANNED', 'RUNNING') THEN 'terminal'
  WHEN previous = 'PLANNED' AND status IN ('RUNNING','STOPPED','FAILED') OR previous = 'RUNNING' AND status IN ('COMPLETED','STOPPED','FAILED') THEN 'allowed' ELSE 'not_allowed' END AS transition FROM s""")
def ledger_transitions(t):
    return op.ledger_transitions(ledger_of(t))


@query("k16_ledger_conflicts", "K16", "", f"""WITH {_LEDGER}
SELECT source_slug, count(*) AS active_runs, count(*) > 1 AS conflict FROM (SELECT run_key, source_slug, arg_max(status, (at_time, id)) AS status FROM led GROUP BY 1, 2) WHERE status IN ('PLANNED', 'RUNNING') GROUP BY 1""")
def ledger_conflicts(t):
    latest = ledger_of(t).groupBy("run_key", "source_slug").agg(F.max_by("status", F.struct("at", "id")).alias("status"))
    return op.ledger_conflicts(latest)


_OPS_SQL = """
own AS (SELECT operation_id, source_slug AS source, kind, kind || '_' || lower(status) AS reason, CASE WHEN kind IN ('source_health', 'freshness_baseline') THEN CASE status WHEN 'FAIL' THEN 'HIGH' ELSE 'MEDIUM' END
    WHEN kind IN ('postwrite', 'no_partial') THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM results WHERE status = 'FAIL' OR (status = 'WARN' AND kind IN ('source_health', 'freshness_baseline'))
  UNION ALL SELECT operation_id, source_slug, kind, 'created_rows', 'CRITICAL' FROM results WHERE kind IN ('postwrite', 'active_write') AND (product_delta <> 0 OR row_delta <> 0)
  UNION ALL SELECT operation_id, source_slug, kind, 'closed', 'HIGH' FROM results WHERE closed
  UNION ALL SELECT o.operation_id, NULL, k.kind, 'required_but_missing', 'HIGH' FROM (SELECT DISTINCT operation_id FROM results) o, (VALUES ('manifest'), ('prewrite'), ('active_write'), ('postwrite')) k(kind)
    WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.operation_id = o.operation_id AND r.kind = k.kind)
  UNION ALL SELECT operation_id, NULL, 'no_partial', 'required_but_missing', 'HIGH' FROM (SELECT operation_id FROM results GROUP BY 1 HAVING bool_or(kind = 'error') AND NOT bool_or(kind = 'no_partial')))"""


@query("k18_operation_blockers", "K18", "results", f"WITH {_OPS_SQL} SELECT * FROM own")
def operation_blockers(t):
    results = results_of(t)
    return op.operation_blockers(results, results.select("operation_id").distinct())


@query("k18_operation_status", "K18", "results", f"""WITH {_OPS_SQL}, c AS (SELECT operation_id, count(*) AS blockers, count(*) FILTER (severity IN ('CRITICAL','HIGH')) AS severe, count(DISTINCT source) AS blocked_sources FROM own GROUP BY 1)
SELECT o.operation_id, coalesce(blockers, 0) AS blockers, coalesce(severe, 0) AS severe, coalesce(blocked_sources, 0) AS blocked_sources, CASE WHEN severe > 0 THEN 'FAIL' WHEN blockers > 0 THEN 'WARN' ELSE 'PASS' END AS status
FROM (SELECT DISTINCT operation_id FROM results) o LEFT JOIN c USING (operation_id)""")
def operation_status(t):
    results = results_of(t)
    operations = results.select("operation_id").distinct()
    return op.operation_status(op.operation_blockers(results, operations), operations)
