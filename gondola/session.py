"""Session construction and the runtime settings the jobs rely on.

No operator calls ``broadcast()``: the join strategy is left to Catalyst and
AQE, which broadcast a side only when its measured size is below
``autoBroadcastJoinThreshold`` and otherwise fall back to a sort-merge join
whose skewed partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Accept the extra shuffle when splitting a hot key would otherwise be
    # skipped because the output feeds an aggregation on the same key.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Cut top-k per source inside each partition, also for larger k.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # Folders of a partitioned table are listed by tasks of many folders each, not one apiece.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    # Rows of the many derived columns are wide; keep one stage per span.
    "spark.sql.codegen.maxFields": "200",
}


#: For the price queries: shuffles start with many partitions, which AQE joins up to a size. What a task holds is then
#: bounded by that size, not by the input over a fixed number of partitions, and uneven tasks fill the cores.
TABLE_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "12m",
}


def tune(spark: SparkSession, settings: dict[str, str] | None = None) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in {**RUNTIME_SETTINGS, **(settings or {})}.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "gondola", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
