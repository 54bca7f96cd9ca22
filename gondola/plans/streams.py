"""Streaming queries: each drains the source table as a stream and returns what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.derive import Tables, N_MARKETS, ean_of, money, slug_of
from ..functions.numeric import currency
from ..sources.stable import shared_folder
from ..streaming import jobs
from .registry import query

#: A batch uploads the keys it changed, not the whole state.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def stream_of(t: Tables, name: str) -> DataFrame:
    return t.spark.readStream.schema(t.raw(name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.dir)


def fresh_base(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def drain(t: Tables, stream: DataFrame) -> DataFrame:
    for key, value in STATE_STORE.items():
        t.spark.conf.set(key, value)
    base = fresh_base(t)
    jobs.run_to_parquet(stream, base).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("l01_price_change_stream", "L1", "observations", """
WITH s AS (SELECT *, row_number() OVER w AS rn, lag(price) OVER w AS p, lag(list_price) OVER w AS l FROM observations WINDOW w AS (PARTITION BY supermarket_product_id ORDER BY scraped_at, id))
SELECT id, supermarket_product_id AS key, scraped_at, price::double AS price, list_price::double AS list_price FROM s WHERE rn = 1 OR price IS DISTINCT FROM p OR list_price IS DISTINCT FROM l""")
def price_change_stream(t):
    k, m = F.col("l_partkey"), F.col("l_suppkey") % N_MARKETS
    prices = t.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = stream_of(t, "lineitem").join(prices, "l_partkey").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.unix_date(F.to_date("l_shipdate"))).alias("id"),
        (k * N_MARKETS + m).alias("key"), F.col("l_shipdate").cast("timestamp").alias("scraped_at"),
        money(currency(F.col("p_retailprice") * (F.lit(1.0) - F.col("l_discount")))).alias("price"), money(F.col("p_retailprice")).alias("list_price"))
    out = drain(t, jobs.price_changes(rows))
    return out.withColumns({c: F.col(c).cast("double") for c in ("price", "list_price")})


_GREEDY = """
sec AS (SELECT key, epoch_us(at_time) // 1000000 AS second, min({{'at': at_time, 'id': id}}) AS first FROM log WHERE {where} GROUP BY 1, 2),
sent AS (SELECT key, min(second) AS second FROM sec GROUP BY 1
  UNION ALL SELECT n.key, n.second FROM sent s, LATERAL (SELECT l.key, l.second FROM sec l WHERE l.key = s.key AND l.second >= s.second + {cooldown} ORDER BY l.second LIMIT 1) n)"""


@query("l02_alert_suppression", "L2", "health", f"""WITH RECURSIVE log AS (SELECT id, source_slug || '/' || error_type AS key, checked_at AS at_time FROM health WHERE NOT is_healthy),
{_GREEDY.format(where='true', cooldown=3600)} SELECT key AS alert, second FROM sent""")
def alert_suppression(t):
    e = stream_of(t, "events").filter("event_type = 'error'")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("blocked", "hash_invalid", "timeout", "network", "unknown")]), (F.col("event_id") % 5 + 1).cast("int"))
    alerts = e.select(F.concat(slug_of(F.col("user_id") % N_MARKETS), F.lit("/"), kind).alias("alert"), F.col("ts").cast("timestamp").alias("at"))
    return drain(t, jobs.suppress_repeats(alerts))


@query("l02_failure_alerts", "L2 F12", "health", f"""WITH RECURSIVE g AS (SELECT *, sum(is_healthy::int) OVER (PARTITION BY source_slug ORDER BY checked_at, id) AS grp FROM health),
log AS (SELECT id, source_slug AS key, checked_at AS at_time, (sum((NOT is_healthy)::int) OVER (PARTITION BY source_slug, grp ORDER BY checked_at, id))::bigint AS failures FROM g),
{_GREEDY.format(where='failures >= 2', cooldown=1800)}
SELECT sec.first.id AS id, s.key AS source_slug, sec.first.at AS checked_at, l.failures FROM sent s JOIN sec USING (key, second) JOIN log l ON l.id = sec.first.id""")
def failure_alerts(t):
    health = stream_of(t, "events").select(
        F.col("event_id").alias("id"), slug_of(F.col("user_id") % N_MARKETS).alias("source_slug"), F.col("ts").cast("timestamp").alias("checked_at"),
        (F.col("event_type") != "error").alias("is_healthy"))
    base = fresh_base(t)
    jobs.stream_failure_alerts(health, base).awaitTermination()
    return t.spark.read.schema(jobs.ALERT_ROWS).parquet(f"{base}/batch=*/kind=alert*").drop("last_second")


@query("l03_daily_trend_stream", "L3 E13", "observations", """
SELECT scraped_at::date::timestamp AS day, count(DISTINCT ean) AS detected FROM observations
WHERE scraped_at::date + INTERVAL 1 DAY <= (SELECT max(scraped_at) FROM observations) - INTERVAL 2 DAY GROUP BY 1""")
def daily_trend_stream(t):
    staged = stream_of(t, "lineitem").select(ean_of(F.col("l_partkey")).alias("ean"), F.col("l_shipdate").cast("timestamp").alias("created_at"))
    return drain(t, jobs.daily_distinct_products(staged))
