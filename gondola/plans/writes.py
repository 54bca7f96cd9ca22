"""Queries that write a table, read it back and compare what arrived."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import promo
from ..operators import merge
from ..sources import sinks, versions
from ..sources.derive import NOW, Tables
from ..sources.stable import shared_folder
from .ingest import BATCH_TABLES, UPSERT_SQL, winners
from .registry import query

RETENTION_DAYS = 90


def _root(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/tables-{uuid4().hex}"


@query("a06_staged_days", "A6", "batch", "SELECT strftime(created_at, '%Y-%m-%d') AS load_day, count(*) AS rows, count(DISTINCT ean) AS eans FROM batch GROUP BY 1")
def staged_days(t):
    root = _root(t)
    sinks.append_staging(t.batch_candidates, root)
    return t.spark.read.parquet(f"{root}/staging_product").groupBy(F.date_format("load_day", "yyyy-MM-dd").alias("load_day")).agg(
        F.count("*").alias("rows"), F.count_distinct("ean").alias("eans"))


@query("a07_health_log", "A7", "health", "SELECT id, source_slug, checked_at, is_healthy, error_type FROM health")
def health_log(t):
    root = _root(t)
    for good in (True, False):  # two appends, as two probes would write
        sinks.append_health(t.source_health.filter(F.col("is_healthy") == good), root)
    return t.spark.read.parquet(f"{root}/source_health").select("id", "source_slug", "checked_at", "is_healthy", "error_type")


@query("a12_run_report", "A12", "runs", """SELECT source_slug, status, count(*) AS runs, sum(products_staged)::bigint AS staged FROM runs GROUP BY 1, 2""")
def run_report(t):
    path = f"{_root(t)}/report"
    sinks.write_report(t.ingestion_run.groupBy("source_slug", "status").agg(
        F.count("*").alias("runs"), F.sum("products_staged").alias("staged")), path)
    return t.spark.read.schema("source_slug string, status string, runs bigint, staged bigint").json(path)


@query("j08_months_dropped", "J8", "observations", f"""
SELECT strftime(scraped_at, '%Y-%m') AS month, count(*) AS rows FROM observations
WHERE scraped_at >= TIMESTAMP '{NOW}' - INTERVAL {RETENTION_DAYS} DAY GROUP BY 1""")
def months_dropped(t):
    """Whole months before the cut go as folders; the month of the cut keeps its younger rows."""
    root = _root(t)
    sinks.append_history(t.observations, root)
    cut = t.spark.sql(f"SELECT date_format(timestamp'{NOW}' - INTERVAL {RETENTION_DAYS} DAY, 'yyyy-MM')").first()[0]
    sinks.drop_partitions(t.spark, f"{root}/price_history", "month", cut)
    left = t.spark.read.option("basePath", f"{root}/price_history").schema("scraped_at timestamp, month string").parquet(f"{root}/price_history")
    return merge.expire(left, "scraped_at", NOW, RETENTION_DAYS * 24).groupBy("month").agg(F.count("*").alias("rows"))


@query("c15_updated_values", "C15", "sp", """
SELECT id, coalesce(CASE WHEN is_available THEN list_price END, price)::double AS price, sku_id FROM sp""")
def updated_values(t):
    values = t.supermarket_products.select("id", F.when(F.col("is_available"), F.col("list_price")).alias("price"), F.lit(None).cast("string").alias("sku_id"))
    rows = merge.update_from_values(t.supermarket_products, values, "id", ["price", "sku_id"])
    return rows.select("id", F.col("price").cast("double").alias("price"), "sku_id")


@query("d15_discount_amounts", "D15", "sp", """
SELECT id, CASE WHEN list_price > price AND list_price > 0 THEN floor((list_price::double - price::double) * 100 + 0.5) / 100 END AS amount FROM sp""")
def discount_amounts(t):
    return t.supermarket_products.select("id", promo.discount_amount(F.col("price"), F.col("list_price")).alias("amount"))


def _merged(t: Tables, batch):
    """State and batch merged into a bucketed table; its folder and the manifests before and after."""
    root = f"{_root(t)}/supermarket_products"
    first = versions.create(t.state_supermarket_products, root, merge.KEY, "supermarket_id", buckets=8)
    return root, first, merge.merge_current(root, batch, t.supermarkets, NOW, first.version)


@query("j03_merged_table", "J3", BATCH_TABLES, f"WITH {UPSERT_SQL} SELECT * EXCLUDE (action) FROM upserted")
def merged_table(t):
    root, _, _ = _merged(t, winners(t))
    return versions.read(t.spark, root).select(
        "id", "product_ean", "supermarket_id", F.col("price").cast("double").alias("price"), "is_available", "sku_id", "last_checked_at")


@query("j03_rewritten_buckets", "J3", BATCH_TABLES, f"""WITH {UPSERT_SQL}
SELECT x.supermarket_id, count(*) AS rows, count(*) FILTER (x.supermarket_id = 2) AS rewritten,
  count(*) FILTER (x.supermarket_id = 2 AND action <> 'keep') AS changed
FROM upserted x LEFT JOIN state_sp o ON o.id = x.id WHERE o.id IS NOT NULL OR x.supermarket_id = 2 GROUP BY 1""")
def rewritten_buckets(t):
    """A batch of one store rewrites the buckets of that store; all others keep the files of the first write."""
    root, first, after = _merged(t, winners(t).filter("source_slug = 'market-2'"))
    old = set(first.writes.values())
    rows = versions.read(t.spark, root, after, with_place=True)
    return rows.groupBy("supermarket_id").agg(
        F.count("*").alias("rows"), F.count_if(~F.col("_write").isin(*old)).alias("rewritten"),
        F.count_if(F.col("last_checked_at") == F.lit(NOW).cast("timestamp")).alias("changed"))
