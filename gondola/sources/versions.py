"""A table kept as versions of its buckets: a merge reads and rewrites the buckets it touches.

Rows lie in ``data/<write>/<part>=<value>/bucket=<n>``, with the bucket a hash of the table's keys. A manifest
per version, ``versions/<n>.json``, names the write that holds each bucket. A merge copies the touched buckets into a write
of its own and then commits a manifest that points to it; buckets it does not touch stay as they are on disk, and
readers of older versions are not disturbed. Manifests are created and never replaced, so of two merges from one
version the second fails. A write without a manifest is invisible; ``vacuum`` removes it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Manifest:
    version: int
    keys: tuple[str, ...]
    part: str  # a column of few values; part of the keys
    buckets: int
    schema: str  # of the rows, as JSON
    writes: dict[tuple[str, int], str] = field(default_factory=dict)  # (part value, bucket) -> write

    def to_json(self) -> str:
        held = [[p, b, w] for (p, b), w in sorted(self.writes.items())]
        return json.dumps({"version": self.version, "keys": self.keys, "part": self.part, "buckets": self.buckets, "schema": self.schema, "writes": held})

    @staticmethod
    def of_json(text: str) -> Manifest:
        m = json.loads(text)
        return Manifest(m["version"], tuple(m["keys"]), m["part"], m["buckets"], m["schema"], {(p, b): w for p, b, w in m["writes"]})


# -- files ---------------------------------------------------------------------------
def _path(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, files = _path(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []


def _commit(spark: SparkSession, root: str, manifest: Manifest) -> Manifest:
    """Creates the manifest's file; fails if another merge has made this version."""
    target, files = _path(spark, f"{root}/versions/{manifest.version:012d}.json")
    out = files.create(target, False)
    try:
        out.write(bytearray(manifest.to_json().encode()))
    finally:
        out.close()
    return manifest


def load(spark: SparkSession, root: str, version: int | None = None) -> Manifest:
    """The manifest of a version, by default the newest."""
    found = [n for n in _names(spark, f"{root}/versions") if n.endswith(".json") and not n.startswith(".")]
    wanted = found[-1] if version is None and found else f"{version or 0:012d}.json"
    if wanted not in found:
        raise ValueError(f"no version {version} in {root}")
    return Manifest.of_json(spark.read.text(f"{root}/versions/{wanted}", wholetext=True).first()[0])


# -- reading and writing --------------------------------------------------------------
def _bucketed(rows: DataFrame, m: Manifest) -> DataFrame:
    # text of the keys, so that the same key in another number type finds its bucket
    key = F.xxhash64(*[F.col(k).cast("string") for k in m.keys])
    return rows.withColumn("_bucket", F.pmod(key, F.lit(m.buckets)).cast("int"))


def _write(rows: DataFrame, root: str, m: Manifest) -> dict[tuple[str, int], str]:
    """Rows into a write of their own, about one file per bucket; gives the buckets it holds."""
    spark, name = rows.sparkSession, f"write-{uuid4().hex}"
    part = F.col(m.part)
    (_bucketed(rows, m).withColumn("_part", part).hint("rebalance", "_part", "_bucket")
     .write.partitionBy("_part", "_bucket").parquet(f"{root}/data/{name}"))
    return {(p.split("=", 1)[1], int(b.split("=", 1)[1])): name
            for p in _names(spark, f"{root}/data/{name}") if p.startswith("_part=")
            for b in _names(spark, f"{root}/data/{name}/{p}") if b.startswith("_bucket=")}


def read(spark: SparkSession, root: str, manifest: Manifest | None = None, only: set[tuple[str, int]] | None = None,
         with_place: bool = False) -> DataFrame:
    """Rows of a version, or of some of its buckets; ``with_place`` adds _part, _bucket and _write."""
    m = manifest or load(spark, root)
    schema = T.StructType.fromJson(json.loads(m.schema))
    places = [f"{root}/data/{w}/_part={p}/_bucket={b}" for (p, b), w in sorted(m.writes.items()) if only is None or (p, b) in only]
    if not places:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*places)
    if not with_place:
        return rows
    name = F.col("_metadata.file_path")
    piece = lambda pattern: F.regexp_extract(name, pattern, 1)
    return rows.withColumns({"_part": piece("/_part=([^/]*)/"), "_bucket": piece("/_bucket=([0-9]+)/").cast("int"), "_write": piece("/data/([^/]*)/")})


def create(rows: DataFrame, root: str, keys: list[str], part: str, buckets: int = 16) -> Manifest:
    """Version 0 of a table. ``part`` is one of the keys and a number or a plain name (it becomes a folder)."""
    m = Manifest(0, tuple(keys), part, buckets, rows.schema.json())
    return _commit(rows.sparkSession, root, replace(m, writes=_write(rows, root, m)))


def touched(changes: DataFrame, m: Manifest) -> set[tuple[str, int]]:
    """Buckets that hold a key of the changes; at most as many as the table has."""
    found = _bucketed(changes.select(*m.keys), m).select(F.col(m.part).cast("string").alias("p"), "_bucket").distinct().collect()
    return {(r.p, r["_bucket"]) for r in found}


def merge(changes: DataFrame, root: str, plan: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None) -> Manifest:
    """A new version in which ``plan(rows of the touched buckets, changes)`` replaces those rows.

    The plan must keep rows in their bucket, as it does when it never changes a key. ``version`` is the one the
    changes were computed from: a newer one in the table is a conflict.
    """
    spark = changes.sparkSession
    m = load(spark, root)
    if version is not None and version != m.version:
        raise ValueError(f"the table is at version {m.version}, the changes are for {version}")
    places = touched(changes, m)
    if not places:
        return m
    schema = T.StructType.fromJson(json.loads(m.schema))
    after = plan(read(spark, root, m, places), changes).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
    written = _write(after, root, m)
    stray = set(written) - places
    if stray:
        raise ValueError(f"the plan moved rows to other buckets: {sorted(stray)[:3]}")
    kept = {k: w for k, w in m.writes.items() if k not in places}
    return _commit(spark, root, replace(m, version=m.version + 1, writes={**kept, **written}))


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes manifests older than the newest ``keep`` and writes that no kept manifest names."""
    names = [n for n in _names(spark, f"{root}/versions") if n.endswith(".json")]
    for old in names[:-keep]:
        path, files = _path(spark, f"{root}/versions/{old}")
        files.delete(path, False)
    used = {w for n in names[-keep:] for w in load(spark, root, int(n.split(".")[0])).writes.values()}
    gone = [n for n in _names(spark, f"{root}/data") if n.startswith("write-") and n not in used]
    for name in gone:
        path, files = _path(spark, f"{root}/data/{name}")
        files.delete(path, True)
    return gone
