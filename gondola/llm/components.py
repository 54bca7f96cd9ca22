"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of each node on the least of them: the smaller ones and the node itself, or the larger ones.

    The minimum has partial sums and the join splits a hot node, so the centre of a large group is no single task.
    """
    if small:
        edges = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = edges.join(least, "u")
    if small:
        hung = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        hung = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.where("a <> b")


def _state(pairs: DataFrame) -> tuple:
    """Number of pairs and the sum of their hashes: one row."""
    return tuple(pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component): each linked node and the least node reachable from it. ``links`` has columns a, b."""
    pairs = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(pairs)
    while True:
        pairs = stored(_star(_star(pairs, small=False), small=True).distinct(), "stars")
        before, state = state, _state(pairs)
        if state == before:
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))
