"""Operations queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import promo
from ..functions.identity import source_lock_key
from ..functions.text import split_ean_list
from ..operators import monitor as op
from ..sources.derive import NOW, Tables, ean_of
from .ingest import EVALUATED_SQL, evaluated
from .registry import query

STAGE_NOW = "2001-08-01 12:00:00"

_SNAPSHOT_SQL = f"""
{EVALUATED_SQL},
production AS (SELECT s.id AS supermarket_id, s.name, s.slug, s.freshness_sla_hours AS sla_hours, count(sp.id) AS total,
    count(sp.id) FILTER (sp.last_checked_at >= TIMESTAMP '{NOW}' - s.freshness_sla_hours * INTERVAL 1 HOUR) AS fresh, max(sp.last_checked_at) AS latest_check_at
  FROM supermarkets s LEFT JOIN sp ON sp.supermarket_id = s.id WHERE s.is_active GROUP BY ALL),
latest_runs AS (SELECT source_slug, id AS run_id, coalesce(finished_at, started_at) AS latest_run_at FROM runs WHERE status IN ('SUCCESS','PARTIAL')
  QUALIFY row_number() OVER (PARTITION BY source_slug ORDER BY coalesce(finished_at, started_at) DESC, id DESC) = 1),
shadow AS (SELECT s.id AS supermarket_id, count(DISTINCT e.ean) FILTER (e.status <> 'REJECTED') AS shadow_total,
    count(DISTINCT e.ean) FILTER (e.status <> 'REJECTED' AND lr.latest_run_at >= TIMESTAMP '{NOW}' - s.freshness_sla_hours * INTERVAL 1 HOUR) AS shadow_fresh,
    lr.latest_run_at FROM supermarkets s LEFT JOIN latest_runs lr ON lr.source_slug = s.slug LEFT JOIN evaluated e ON e.run_id = lr.run_id
  WHERE s.is_active GROUP BY s.id, lr.latest_run_at),
picked AS (SELECT p.*, shadow_total, shadow_fresh, latest_run_at,
    coalesce(shadow_total > 0 AND (latest_check_at IS NULL OR latest_run_at > latest_check_at), false) AS use_shadow
  FROM production p JOIN shadow USING (supermarket_id)),
chosen AS (SELECT supermarket_id, name, slug, sla_hours, CASE WHEN use_shadow THEN shadow_total ELSE total END AS total_rows,
    CASE WHEN use_shadow THEN shadow_fresh ELSE fresh END AS fresh_rows,
    CASE WHEN use_shadow THEN latest_run_at ELSE latest_check_at END AS latest_check_at, CASE WHEN use_shadow THEN 'shadow' ELSE 'production' END AS basis FROM picked),
snapshot AS (SELECT *, CASE WHEN total_rows > 0 THEN floor(fresh_rows::double / total_rows * 100 * 10 + 0.5)/10 ELSE 0 END AS freshness_percent FROM chosen)"""
_SNAPSHOT_TABLES = "staging observations sp supermarkets runs"


def snapshot(t: Tables) -> DataFrame:
    return op.freshness_snapshot(
        op.production_freshness(t.supermarket_products, t.supermarkets, NOW),
        op.shadow_freshness(t.supermarkets, t.ingestion_run, evaluated(t), NOW))


@query("f03_latest_good_runs", "F3", "runs", """
SELECT source_slug, id AS run_id, coalesce(finished_at, started_at) AS latest_run_at FROM runs WHERE status IN ('SUCCESS','PARTIAL')
QUALIFY row_number() OVER (PARTITION BY source_slug ORDER BY coalesce(finished_at, started_at) DESC, id DESC) = 1""")
def latest_good_runs(t):
    return op.latest_good_runs(t.ingestion_run)


@query("e11_freshness_snapshot", "C3 C4 E11 D19", _SNAPSHOT_TABLES, f"""WITH {_SNAPSHOT_SQL}
SELECT *, freshness_percent < 95 AS below_target, freshness_percent < 80 AS below_alert FROM snapshot""")
def freshness_snapshot(t):
    return snapshot(t)


@query("e11_freshness_overall", "E11", _SNAPSHOT_TABLES, f"""WITH {_SNAPSHOT_SQL}
SELECT sum(total_rows)::bigint AS total_rows, sum(fresh_rows)::bigint AS fresh_rows, count(*) FILTER (freshness_percent < 95) AS sources_below_target,
  count(*) FILTER (freshness_percent < 80) AS sources_below_alert,
  CASE WHEN count(DISTINCT basis) FILTER (total_rows > 0) > 1 THEN 'mixed' ELSE coalesce(min(basis) FILTER (total_rows > 0), 'production') END AS mode,
  CASE WHEN sum(total_rows) > 0 THEN floor(sum(fresh_rows)::double / sum(total_rows)::double * 100 * 10 + 0.5)/10 ELSE 0 END AS freshness_percent FROM snapshot""")
def freshness_overall(t):
    return op.freshness_overall(snapshot(t))


_PANEL_SQL = """
last AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source_slug ORDER BY started_at DESC, id DESC) = 1),
run_panel AS (SELECT s.slug, s.name, l.batch_id, coalesce(l.status, 'NO_DATA') AS status, l.started_at, coalesce(products_staged, 0) AS products_staged,
  coalesce(products_rejected, 0) AS products_rejected,
  CASE WHEN products_staged > 0 THEN floor(products_rejected::double / products_staged * 100 * 10 + 0.5)/10 ELSE 0 END AS rejection_rate
  FROM supermarkets s LEFT JOIN last l ON l.source_slug = s.slug WHERE s.is_active),
hlast AS (SELECT * FROM health QUALIFY row_number() OVER (PARTITION BY source_slug ORDER BY checked_at DESC, id DESC) = 1),
health_panel AS (SELECT s.slug, CASE WHEN is_healthy IS NULL THEN 'no_data' WHEN is_healthy THEN 'healthy'
  WHEN error_type IN ('blocked','hash_invalid','timeout','network') THEN error_type ELSE 'unknown' END AS state,
  coalesce(is_healthy, false) AS is_healthy, coalesce(hash_valid, false) AS hash_valid, response_time_ms,
  coalesce(products_returned, 0) AS products_returned, error_type
  FROM supermarkets s LEFT JOIN hlast h ON h.source_slug = s.slug WHERE s.is_active)"""


@query("e39_run_panel", "E39 F4", "runs health supermarkets", f"WITH {_PANEL_SQL} SELECT * FROM run_panel")
def run_panel(t):
    return op.run_panel(t.supermarkets, t.ingestion_run).select(
        "slug", "name", "batch_id", "status", "started_at", "products_staged", "products_rejected", "rejection_rate")


@query("d37_health_panel", "D37 F4", "runs health supermarkets", f"WITH {_PANEL_SQL} SELECT * FROM health_panel")
def health_panel(t):
    return op.health_panel(t.supermarkets, t.source_health).select(
        "slug", "state", "is_healthy", "hash_valid", "response_time_ms", "products_returned", "error_type")


@query("e12_quality_histogram", "E12", "staging observations", f"""WITH {EVALUATED_SQL},
recent AS (SELECT quality_score AS q FROM evaluated WHERE created_at >= TIMESTAMP '{STAGE_NOW}' - INTERVAL 30 DAY)
SELECT unnest(['0-24','25-49','50-74','75-89','90-100']) AS bucket, unnest([count(*) FILTER (q < 0.25), count(*) FILTER (q >= 0.25 AND q < 0.5),
  count(*) FILTER (q >= 0.5 AND q < 0.75), count(*) FILTER (q >= 0.75 AND q < 0.9), count(*) FILTER (q >= 0.9)]) AS rows FROM recent""")
def quality_histogram(t):
    return op.quality_histogram(evaluated(t), STAGE_NOW)


_TREND_SQL = f"""
calendar AS (SELECT unnest(generate_series(DATE '2001-08-01' - INTERVAL 29 DAY, DATE '2001-08-01', INTERVAL 1 DAY))::date AS day),
detected AS (SELECT created_at::date AS day, count(DISTINCT ean) AS detected FROM staging GROUP BY 1),
counted AS (SELECT started_at::date AS day, sum(products_staged)::bigint AS staged, sum(products_promoted)::bigint AS promoted, sum(products_rejected)::bigint AS rejected FROM runs GROUP BY 1),
trend AS (SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(detected, 0) AS detected, coalesce(staged, 0) AS staged, coalesce(promoted, 0) AS promoted, coalesce(rejected, 0) AS rejected
  FROM calendar LEFT JOIN detected USING (day) LEFT JOIN counted USING (day))"""


@query("e13_ingestion_trend", "E13", "staging runs", f"WITH {_TREND_SQL} SELECT * FROM trend")
def ingestion_trend(t):
    return op.ingestion_trend(t.staging_product, t.ingestion_run, STAGE_NOW).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("e14_admin_overview", "E14", _SNAPSHOT_TABLES + " health", f"""WITH {_SNAPSHOT_SQL}, {_PANEL_SQL}, {_TREND_SQL}
SELECT (SELECT max(started_at) FROM run_panel) AS latest_run_at, (SELECT count(*) FROM run_panel WHERE status = 'FAILED') AS failed_sources,
  (SELECT count(*) FROM health_panel WHERE state = 'healthy') AS healthy_sources, (SELECT count(*) FROM health_panel WHERE state = 'blocked') AS blocked_sources,
  (SELECT floor(sum(fresh_rows)::double / sum(total_rows)::double * 100 * 10 + 0.5)/10 FROM snapshot) AS freshness_percent,
  (SELECT count(*) FROM snapshot WHERE freshness_percent < 80) AS sources_below_sla,
  (SELECT sum(promoted)::bigint FROM trend) AS promoted, (SELECT sum(rejected)::bigint FROM trend) AS rejected,
  (SELECT floor(avg(quality_score) * 100 * 10 + 0.5)/10 FROM evaluated WHERE created_at >= TIMESTAMP '{STAGE_NOW}' - INTERVAL 30 DAY) AS average_quality""")
def admin_overview(t):
    return op.admin_overview(t.supermarkets, t.ingestion_run, t.source_health, t.supermarket_products, evaluated(t), NOW, STAGE_NOW)


_STATS_SQL = f"""
stats AS (SELECT s.id, s.name, s.slug, count(*) FILTER (last_checked_at >= TIMESTAMP '{NOW}' - INTERVAL 720 HOUR) AS updated,
  count(*) FILTER (last_checked_at < TIMESTAMP '{NOW}' - INTERVAL 720 HOUR) AS stale,
  max(last_checked_at) FILTER (last_checked_at >= TIMESTAMP '{NOW}' - INTERVAL 720 HOUR) AS latest_check_at
  FROM supermarkets s LEFT JOIN sp ON sp.supermarket_id = s.id GROUP BY ALL)"""


@query("e15_scraper_stats", "E15", "sp supermarkets", f"WITH {_STATS_SQL} SELECT * FROM stats")
def scraper_stats(t):
    return op.scraper_stats(t.supermarkets, t.supermarket_products, NOW, 720)


@query("e15_scraper_overview", "E15", "sp supermarkets observations", f"""WITH {_STATS_SQL}
SELECT sum(updated)::bigint AS updated, count(*) FILTER (updated > 0) AS active_stores, sum(stale)::bigint AS stale,
  (SELECT count(*) FROM observations WHERE scraped_at >= TIMESTAMP '{NOW}' - INTERVAL 720 HOUR) AS history_records,
  (SELECT max(last_checked_at) FROM sp) AS latest_run_at FROM stats""")
def scraper_overview(t):
    stats = op.scraper_stats(t.supermarkets, t.supermarket_products, NOW, 720)
    return op.scraper_overview(stats, t.supermarket_products, t.observations, NOW, 720)


@query("e29_ingest_alerts", "E29", _SNAPSHOT_TABLES + " health", f"""WITH {_SNAPSHOT_SQL}, {_PANEL_SQL},
src AS (SELECT * FROM run_panel JOIN health_panel USING (slug))
SELECT 'hash_invalid_all_sources' AS alert, slug FROM src WHERE (SELECT bool_and(NOT is_healthy AND coalesce(error_type = 'hash_invalid', false)) FROM src)
UNION ALL SELECT 'blocked_sources', slug FROM src WHERE error_type = 'blocked'
UNION ALL SELECT 'quality_degradation', slug FROM src WHERE products_staged > 0 AND products_rejected / products_staged > 0.1
UNION ALL SELECT 'freshness_sla_violation', slug FROM snapshot WHERE freshness_percent < 80""")
def ingest_alerts(t):
    runs = op.run_panel(t.supermarkets, t.ingestion_run).select(
        "slug", F.col("products_staged").alias("staged"), F.col("products_rejected").alias("rejected"))
    health = op.health_panel(t.supermarkets, t.source_health).select("slug", "is_healthy", "error_type")
    return op.ingest_alerts(snapshot(t), runs.join(health, "slug"))


@query("f12_failure_streaks", "F12", "health", """
WITH g AS (SELECT *, sum(is_healthy::int) OVER (PARTITION BY source_slug ORDER BY checked_at, id) AS grp FROM health)
SELECT id, source_slug, checked_at, is_healthy, (sum((NOT is_healthy)::int) OVER (PARTITION BY source_slug, grp ORDER BY checked_at, id))::bigint AS failures FROM g""")
def failure_streaks(t):
    return op.failure_streaks(t.source_health)


@query("e30_stuck_work", "E30", "runs staging observations", f"""WITH {EVALUATED_SQL},
c AS (SELECT 'stuck_running_runs' AS "check", count(*) AS rows FROM runs WHERE status = 'RUNNING' AND started_at < TIMESTAMP '{STAGE_NOW}' - INTERVAL 60 MINUTE
UNION ALL SELECT 'old_pending_rows', count(*) FROM evaluated WHERE status = 'PENDING' AND created_at < TIMESTAMP '{STAGE_NOW}' - INTERVAL 60 MINUTE)
SELECT *, CASE WHEN rows > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM c""")
def stuck_work(t):
    return op.stuck_work(t.ingestion_run, evaluated(t), STAGE_NOW)


@query("e31_staging_state", "E31", "staging observations", f"""WITH {EVALUATED_SQL}
SELECT count(*) AS total, count(*) FILTER (status='PENDING') AS pending, count(*) FILTER (status='PROMOTED') AS promoted,
  count(*) FILTER (status='REJECTED') AS rejected, count(*) FILTER (created_at < TIMESTAMP '{STAGE_NOW}' - INTERVAL 48 HOUR) AS stale_48h,
  count(DISTINCT run_id) AS runs FROM evaluated""")
def staging_state(t):
    return op.staging_state(evaluated(t), STAGE_NOW)


@query("e32_product_stats", "E32", "products", "SELECT count(*) AS total, count(DISTINCT category) AS categories, count(DISTINCT brand) AS brands, count(image_url) AS with_image FROM products")
def product_stats(t):
    return op.product_stats(t.products)


@query("e33_store_coverage", "E33", "sp supermarkets", """
SELECT s.id, s.name, count(*) AS rows, floor(count(*)::double / (SELECT count(*) FROM sp) * 100 * 100 + 0.5)/100 AS share
FROM sp JOIN supermarkets s ON s.id = supermarket_id GROUP BY 1, 2""")
def store_coverage(t):
    return op.store_coverage(t.supermarket_products, t.supermarkets)


@query("e34_history_growth", "E34", "observations", """
SELECT count(*) AS rows, count(DISTINCT supermarket_product_id) AS keys, min(scraped_at) AS oldest, max(scraped_at) AS newest FROM observations""")
def history_growth(t):
    return op.history_growth(t.observations)


@query("g11_run_history", "G11", "runs", "SELECT id, batch_id, source_slug, status, duration_ms FROM runs ORDER BY started_at DESC, id DESC LIMIT 20")
def run_history(t):
    return op.run_history(t.ingestion_run).select("id", "batch_id", "source_slug", "status", "duration_ms")


@query("g13_admin_promotions", "B11 G13 D14", "promotions promotion_products", f"""
SELECT p.id, p.title, CASE WHEN NOT is_active THEN 'inactive' WHEN start_date > TIMESTAMP '{NOW}' THEN 'scheduled'
  WHEN end_date < TIMESTAMP '{NOW}' THEN 'expired' ELSE 'active' END AS lifecycle, coalesce(string_agg(product_ean, ',' ORDER BY product_ean), '') AS eans
FROM promotions p LEFT JOIN promotion_products b ON b.promotion_id = p.id WHERE end_date < TIMESTAMP '{NOW}'
  AND (contains(lower(title), '7') OR contains(lower(wallet_provider), '7') OR contains(lower(bank_name), '7') OR contains(lower(conditions), '7')) GROUP BY ALL""")
def admin_promotions(t):
    rows = op.admin_promotions(t.promotions, t.promotion_products, NOW, status="expired", query="7")
    return rows.select("id", "title", "lifecycle", F.array_join("eans", ",").alias("eans"))


@query("d14_promotion_lifecycle", "D14", "promotions", f"""
SELECT id, CASE WHEN NOT is_active THEN 'inactive' WHEN start_date > TIMESTAMP '{NOW}' THEN 'scheduled'
  WHEN end_date < TIMESTAMP '{NOW}' THEN 'expired' ELSE 'active' END AS lifecycle FROM promotions""")
def promotion_lifecycle(t):
    return t.promotions.select("id", promo.lifecycle(F.col("is_active"), F.col("start_date"), F.col("end_date"), NOW).alias("lifecycle"))


@query("e16_promotion_stats", "E16", "promotions", f"""
SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (start_date > TIMESTAMP '{NOW}') AS scheduled,
  count(*) FILTER (end_date < TIMESTAMP '{NOW}') AS expired FROM promotions""")
def promotion_stats(t):
    return op.promotion_stats(t.promotions, NOW)


@query("j09_promotion_checks", "J9", "promotions promotion_products state_products supermarkets", """
WITH feed AS (SELECT id, id % 8 AS supermarket_id, type, CASE WHEN id % 40 = 3 THEN 'ab' ELSE title END AS title,
  CASE WHEN id % 6 <> 0 THEN wallet_provider END AS wallet_provider, CASE WHEN id % 6 <> 1 THEN bank_name END AS bank_name, start_date,
  CASE WHEN id % 50 = 4 THEN start_date - INTERVAL 1 DAY ELSE end_date END AS end_date FROM promotions)
SELECT id, array_to_string(list_filter([CASE WHEN len(title) < 3 OR len(title) > 160 THEN 'title_length' END,
  CASE WHEN type = 'wallet_discount' AND wallet_provider IS NULL THEN 'wallet_provider_missing' END,
  CASE WHEN type = 'bank_discount' AND bank_name IS NULL THEN 'bank_name_missing' END,
  CASE WHEN end_date < start_date THEN 'end_before_start' END,
  CASE WHEN supermarket_id NOT IN (SELECT id FROM supermarkets) THEN 'unknown_store' END,
  CASE WHEN EXISTS (SELECT 1 FROM promotion_products b WHERE b.promotion_id = feed.id AND b.product_ean NOT IN (SELECT ean FROM state_products)) THEN 'unknown_product' END],
  lambda x: x IS NOT NULL), ',') AS reasons FROM feed""")
def promotion_checks(t):
    k = F.col("id")
    day = F.timestamp_micros(F.unix_micros("start_date") - F.lit(86_400_000_000))
    feed = t.promotions.withColumns({
        "supermarket_id": k % 8, "title": F.when(k % 40 == 3, "ab").otherwise(F.col("title")),
        "wallet_provider": F.when(k % 6 != 0, F.col("wallet_provider")), "bank_name": F.when(k % 6 != 1, F.col("bank_name")),
        "end_date": F.when(k % 50 == 4, day).otherwise(F.col("end_date"))})
    rows = op.validate_promotions(feed, t.promotion_products, t.supermarkets, t.state_products)
    return rows.select("id", F.array_join("reasons", ",").alias("reasons"))


# a third of the promotions is updated (some at an unknown store or id, some without a wallet), a tenth is entered anew
_FEED_SQL = """
feed AS (SELECT id AS feed_key, CASE WHEN id % 10 = 1 THEN NULL WHEN id % 30 = 9 THEN id + 10000000 ELSE id END AS id, id % 8 AS supermarket_id, type,
    '  New ' || title || ' ' AS title, CASE WHEN id % 6 <> 0 THEN wallet_provider END AS wallet_provider, bank_name, discount_value, conditions, start_date, end_date, NOT is_active AS is_active
  FROM promotions WHERE id % 3 = 0 OR id % 10 = 1),
np AS (SELECT count(*) AS n FROM part),
listed AS (SELECT DISTINCT feed_key, lpad(cast((feed_key * m) % np.n AS varchar), 13, '0') AS product_ean FROM feed, np, (VALUES (7), (11), (7)) v(m) WHERE feed_key % 4 <> 0),
verdicts AS (SELECT feed_key, id, list_filter([CASE WHEN type = 'wallet_discount' AND wallet_provider IS NULL THEN 'wallet_provider_missing' END,
    CASE WHEN supermarket_id NOT IN (SELECT id FROM supermarkets) THEN 'unknown_store' END,
    CASE WHEN EXISTS (SELECT 1 FROM listed b WHERE b.feed_key = feed.feed_key AND b.product_ean NOT IN (SELECT ean FROM state_products)) THEN 'unknown_product' END,
    CASE WHEN id IS NOT NULL AND id NOT IN (SELECT id FROM promotions) THEN 'not_found' END], lambda x: x IS NOT NULL) AS reasons FROM feed),
ok AS (SELECT feed.*, coalesce(feed.id, (SELECT max(id) FROM promotions) + row_number() OVER (PARTITION BY feed.id IS NULL ORDER BY md5(feed_key::varchar), feed_key)) AS target
  FROM feed JOIN verdicts USING (feed_key) WHERE len(reasons) = 0),
after AS (
  SELECT p.id, p.supermarket_id, p.type, p.title, p.wallet_provider, p.is_active FROM promotions p WHERE p.id NOT IN (SELECT target FROM ok)
  UNION ALL SELECT target, supermarket_id, type, trim(title), wallet_provider, is_active FROM ok),
lists AS (SELECT promotion_id, product_ean FROM promotion_products WHERE promotion_id NOT IN (SELECT target FROM ok)
  UNION ALL SELECT target, product_ean FROM ok JOIN listed USING (feed_key))"""
_FEED_TABLES = "promotions promotion_products state_products supermarkets"


def applied_promotions(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("id")
    feed = t.promotions.filter((k % 3 == 0) | (k % 10 == 1)).select(
        k.alias("feed_key"), F.when(k % 10 == 1, None).when(k % 30 == 9, k + 10_000_000).otherwise(k).alias("id"), (k % 8).alias("supermarket_id"), "type",
        F.concat(F.lit("  New "), "title", F.lit(" ")).alias("title"), F.when(k % 6 != 0, F.col("wallet_provider")).alias("wallet_provider"),
        "bank_name", "discount_value", "conditions", "start_date", "end_date", (~F.col("is_active")).alias("is_active"))
    parts = t.raw("part").select(F.count("*")).scalar()
    ean = lambda m: F.concat(F.lit(" "), ean_of((F.col("feed_key") * m) % parts))
    listed = feed.filter("feed_key % 4 <> 0").select("feed_key", F.explode(F.array(ean(7), ean(11), ean(7), F.lit(" "))).alias("product_ean"))
    return op.apply_promotions(t.promotions, t.promotion_products, feed, listed, t.supermarkets, t.state_products)


@query("j09_applied_promotions", "J9", _FEED_TABLES, f"WITH {_FEED_SQL} SELECT * FROM after")
def promotions_after_feed(t):
    return applied_promotions(t)[0].select("id", "supermarket_id", "type", "title", "wallet_provider", "is_active")


@query("j09_applied_lists", "J9", _FEED_TABLES, f"WITH {_FEED_SQL} SELECT * FROM lists")
def promotion_lists_after_feed(t):
    return applied_promotions(t)[1]


@query("j09_feed_verdicts", "J9", _FEED_TABLES, f"WITH {_FEED_SQL} SELECT feed_key, id, array_to_string(reasons, ',') AS reasons FROM verdicts")
def promotion_feed_verdicts(t):
    return applied_promotions(t)[2].withColumn("reasons", F.array_join("reasons", ","))


@query("d34_promotion_ean_lists", "D34", "promotion_products", """
SELECT promotion_id, product_ean || '|99999999' AS eans FROM promotion_products""")
def promotion_ean_lists(t):
    text = F.concat(F.lit(" "), F.col("product_ean"), F.lit(",\n99999999 ; "), F.col("product_ean"))
    return t.promotion_products.select("promotion_id", F.array_join(split_ean_list(text), "|").alias("eans"))


@query("d38_source_lock_keys", "D38", "supermarkets", """
SELECT slug, CASE WHEN k = 0 THEN 1 ELSE k END AS lock_key FROM (SELECT slug, ('0x' || substr(sha256(slug), 1, 8))::bigint & 2147483647 AS k FROM
  (SELECT DISTINCT p_brand AS slug FROM part))""")
def source_lock_keys(t):
    return t.raw("part").select(F.col("p_brand").alias("slug")).distinct().select("slug", source_lock_key(F.col("slug")).alias("lock_key"))
