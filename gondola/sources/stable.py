"""Order-preserving splits of skewed logs, and the shared folder of streams."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is not None:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def ordered_chunks(rows: DataFrame, time: str) -> DataFrame:
    """Rows with ``chunk``, the hour they fall into: contiguous pieces of every key's order.

    The hour comes from the row itself, so all plans and retries agree on it, and
    a task holds at most one key's rows of one hour.
    """
    return rows.withColumn("chunk", F.floor(F.unix_micros(time) / HOUR))


def carried(chunks: DataFrame, keys: list[str], totals: dict) -> DataFrame:
    """Per (key, chunk) aggregates for carrying running values across chunks.

    The result has at most one row per key and chunk, so a window over it stays small.
    """
    return chunks.groupBy(*keys, "chunk").agg(*[v.alias(k) for k, v in totals.items()])


def before(keys: list[str]) -> "Window":
    """All earlier chunks of the key."""
    return Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)


def previous_in_order(rows: DataFrame, key: str, order: list[str], column: str, out: str) -> DataFrame:
    """``column`` of the preceding row of the same key, without one task per key.

    ``order`` starts with a timestamp. A lag inside contiguous chunks; the first row of a chunk takes the key's last
    value from its nearest earlier chunk.
    """
    chunks = ordered_chunks(rows, order[0])
    inside = Window.partitionBy(key, "chunk").orderBy(*order)
    local = chunks.withColumn("_n", F.row_number().over(inside)).withColumn("_lag", F.lag(F.struct(column)).over(inside))
    ends = carried(chunks, [key], {"_end": F.max_by(F.struct(column), F.struct(*order))})
    step = Window.partitionBy(key).orderBy("chunk")
    carry = ends.select(key, "chunk", F.lag("_end").over(step).alias("_carry"))
    before_row = F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    return local.join(carry, [key, "chunk"]).withColumn("_before", before_row).withColumns({
        out: F.col(f"_before.{column}"), "is_first": F.col("_before").isNull()}).drop("chunk", "_n", "_lag", "_carry", "_before")
