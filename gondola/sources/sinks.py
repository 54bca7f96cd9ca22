"""Table writers. Each is one append or one overwrite of a new snapshot path."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES
from .stable import shared_folder


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


#: Sizes of a task of a partitioned write, in shuffled bytes. The least one is small, so that few rows still use all cores.
WRITE_TASKS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}


def _append(rows: DataFrame, column: str, path: str) -> None:
    """Append partitioned by ``column``, with the rows of a value together, so that files are about as many as values.

    The rows are worked out once and dealt by value; AQE joins small pieces up to a size, or to as many as there are cores
    (making a file for each value is what takes the time where rows are few), and cuts a value with more rows than that.
    So what a task sorts is bounded by the size, not by the table over a number of tasks.
    """
    conf = rows.sparkSession.conf
    before = {name: conf.get(name) for name in WRITE_TASKS}
    try:
        for name, size in WRITE_TASKS.items():
            conf.set(name, size)
        rows.hint("rebalance", 1024, column).write.mode("append").partitionBy(column).parquet(path)
    finally:
        for name, size in before.items():
            conf.set(name, size)


def append_staging(rows: DataFrame, root: str) -> None:
    """Append candidates partitioned by load day, so expiry drops whole partitions."""
    _append(rows.withColumn("load_day", F.to_date("created_at")), "load_day", f"{root}/staging_product")


def append_history(rows: DataFrame, root: str) -> None:
    _append(rows.withColumn("month", F.date_format("scraped_at", "yyyy-MM")), "month", f"{root}/price_history")


def append_health(rows: DataFrame, root: str) -> None:
    rows.write.mode("append").parquet(f"{root}/source_health")


def drop_partitions(spark: SparkSession, path: str, column: str, before: str) -> list[str]:
    """Remove the partition folders whose value sorts before ``before``; returns the values removed.

    Only folder names are read, so the cost follows the number of partitions, not the rows.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith(f"{column}=")]
    old = [p for p in found if p.getName().split("=", 1)[1] < before]
    for p in old:
        files.delete(p, True)
    return sorted(p.getName().split("=", 1)[1] for p in old)


def written(rows: DataFrame, name: str) -> DataFrame:
    """Rows through a table of their own in the shared folder, for inputs that several plans read."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_snapshot(rows: DataFrame, root: str, name: str, version: str) -> str:
    """A complete new version of a table in its own directory; readers switch after success."""
    path = f"{root}/{name}/version={version}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
