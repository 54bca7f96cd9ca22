"""Sharding by a hypergeometric communication matrix, with DataFrame functions only.

A uniform shuffle into shards of exact sizes, without sorting all rows: rows are
first written in pieces of at most 65,536, as they lie in their partition. The
matrix of counts from piece to shard that a uniform permutation would have is
drawn for itself: the shards' sizes are dealt down a tree, from all pieces to
groups of about 128 to single pieces, by hypergeometric draws, so every row and
column sum is exact. Inside a piece a random order then decides which rows make
up its count for each shard; after the exchange each shard is put in random
order again, in parts whose sizes are prefix-summed, so that no task orders a
whole shard.

Random numbers are hashes of a seed and the place of a row or piece in the
written table, so retried tasks and lost executors repeat the same draws.

Law ``rows``: shard sizes differ by one row at most, the first shards being the
larger. Rows of equal texts are not held together: that law leaves no room for
it, and a group of copies is spread like all rows.

Cases: null texts have size 1 and the checksum of an empty text; null ids and
repeated rows are rows like others; fewer rows than shards leave the last shards
empty; an empty table gives an empty result. The rows travel in a struct
``doc``, so their column names never clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

SHARDS = 16
PIECE_BITS = 16
GROUP = 128
PART_ROWS = 1 << 16
#: Pairs of uniform numbers for one draw: the first few nearly always suffice, the rest make a miss less likely than 1e-15.
TRIALS = (24, 160)

_HALF_LOG_2PI = 0.9189385332046727
_FIRST_LOGS = 16


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def uniform(*parts: Column | int) -> Column:
    """A number in (0, 1), hashed from the parts."""
    h = F.xxhash64(*[F.lit(p) if isinstance(p, (int, str)) else p for p in parts])
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def log_factorial(n: Column) -> Column:
    """ln n!: a table for small n, Stirling's series beyond."""
    small = F.get(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(_FIRST_LOGS)]), n.cast("int"))
    x = n + F.lit(1.0)
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < _FIRST_LOGS, small).otherwise((x - 0.5) * F.log(x) - x + _HALF_LOG_2PI + series)


def hypergeometric(total: Column, good: Column, drawn: Column, *salt: Column | int) -> Column:
    """How many of ``drawn`` rows, out of ``total`` with ``good`` marked ones, are marked.

    Ratio of uniforms: a point (u, v) of a box gives the value at v / u, kept where u squared lies below the
    probability there over that of the mode. The box has the known bounds for discrete unimodal laws, from
    the mean and the variance.
    """
    lowest, highest = F.greatest(F.lit(0), drawn - (total - good)), F.least(good, drawn)
    share = good.cast("double") / total
    variance = F.when(total > 1, drawn * share * (1 - share) * (total - drawn) / (total - 1)).otherwise(0.0)
    mode = F.floor((drawn + 1).cast("double") * (good + 1) / (total + 2))

    def weight(k: Column) -> Column:
        return -(log_factorial(k) + log_factorial(good - k) + log_factorial(drawn - k) + log_factorial(total - good - drawn + k))

    def choose(box: Column) -> Column:
        def first(begin: int, end: int) -> Column:
            def point(t: Column) -> Column:
                u, v = uniform(t, 1, *salt), uniform(t, 2, *salt)
                return F.struct(F.log(u).alias("u"), F.floor(box["mean"] + 0.5 + box["width"] * (v - 0.5) / u).alias("k"))

            points = F.transform(F.sequence(F.lit(begin), F.lit(end - 1)), point)
            inside = F.filter(points, lambda p: (p["k"] >= lowest) & (p["k"] <= highest))
            return F.get(F.filter(inside, lambda p: 2 * p["u"] <= weight(p["k"]) - box["top"]), F.lit(0))["k"]

        return F.coalesce(first(0, TRIALS[0]), first(*TRIALS), box["mode"])

    box = let(mode.cast("bigint"), lambda m: F.struct(
        (drawn * share).alias("mean"), (1.7155277699214135 * F.sqrt(variance + 0.5) + 0.8989161620588988).alias("width"),
        weight(m).alias("top"), m.alias("mode")))
    return F.when(lowest >= highest, highest).otherwise(let(box, choose)).cast("bigint")


def dealt_counts(sizes: Column, left: Column, seed: int) -> Column:
    """Counts per shard for each of ``sizes`` (unit, n), drawn one after the other from what is left of every shard."""
    none = F.array().cast("array<bigint>")

    def one_unit(unit: Column, remaining: Column) -> Column:
        def one_shard(state: Column, j: Column) -> Column:
            here = F.get(remaining, j)
            return let(hypergeometric(state["pool"], here, state["rows"], unit["unit"], j, seed), lambda k: F.struct(
                (state["rows"] - k).alias("rows"), (state["pool"] - here).alias("pool"),
                F.concat(state["counts"], F.array(k)).alias("counts")))

        pool = F.aggregate(remaining, F.lit(0).cast("bigint"), lambda a, b: a + b)
        start = F.struct(unit["n"].alias("rows"), pool.alias("pool"), none.alias("counts"))
        return F.aggregate(F.sequence(F.lit(0), F.size(remaining) - 1), start, one_shard)["counts"]

    def step(state: Column, unit: Column) -> Column:
        return let(one_unit(unit, state["left"]), lambda counts: F.struct(
            F.zip_with(state["left"], counts, lambda a, b: a - b).alias("left"),
            F.concat(state["out"], F.array(F.struct(unit["unit"].alias("unit"), counts.alias("counts")))).alias("out")))

    out = F.array().cast("array<struct<unit:bigint,counts:array<bigint>>>")
    return F.aggregate(sizes, F.struct(left.alias("left"), out.alias("out")), step)["out"]


def shard_sizes(total: Column, shards: int) -> Column:
    """At most one row apart; the first shards take what is left over."""
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: (
        F.floor(total / shards) + F.when(j < total % shards, 1).otherwise(0)).cast("bigint"))


def communication_matrix(pieces: DataFrame, shards: int, seed: int = 1, group: int = GROUP) -> DataFrame:
    """pieces: unit, n. Gives (unit, counts), an array with the rows each shard takes of the unit.

    Units fall into groups by hash, groups into groups, until one is left; then the shards' sizes go down
    the same way. A group is one array of about ``group`` sizes, at any number of pieces.
    """
    count = pieces.count()
    levels, width = [pieces], count
    while width > group:
        width = -(-width // group)
        above = F.pmod(F.xxhash64("unit", F.lit(seed + len(levels))), F.lit(width))
        levels[-1] = levels[-1].withColumn("above", above)
        levels.append(levels[-1].groupBy(F.col("above").alias("unit")).agg(F.sum("n").alias("n")))
    top = levels.pop()
    listed = F.array_sort(F.collect_list(F.struct("unit", "n"))).alias("sizes")
    # one row of at most ``group`` sizes
    whole = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, u: a + u["n"])
    dealt = top.agg(listed).select(F.explode(dealt_counts(F.col("sizes"), shard_sizes(whole, shards), seed * 100)).alias("d"))
    for depth, level in enumerate(reversed(levels), 1):
        counts = dealt.select(F.col("d.unit").alias("above"), "d.counts")
        sizes = level.groupBy("above").agg(listed).join(counts, "above")
        dealt = sizes.select(F.explode(dealt_counts(F.col("sizes"), F.col("counts"), seed * 100 + depth)).alias("d"))
    return dealt.select("d.unit", "d.counts")


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 1, piece_bits: int = PIECE_BITS, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc, shard, slot): every row in a uniform random place, ``slot`` counting from 0 in its shard."""
    if shards < 1:
        raise ValueError("at least one shard")
    placed = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("at")), "placed")
    unit = F.expr(f"shiftright(at, {piece_bits})")
    pieces = stored(placed.groupBy(unit.alias("unit")).agg(F.count("*").alias("n")), "pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    matrix = communication_matrix(pieces, shards, seed)
    ends = F.aggregate(F.col("counts"), F.array().cast("array<bigint>"), lambda a, c: F.concat(
        a, F.array(c + F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)))))
    order = Window.partitionBy("unit").orderBy("_first", "at")
    local = placed.withColumn("unit", unit).withColumn("_first", F.xxhash64("at", F.lit(seed), F.lit("first"))).withColumn(
        "_n", F.row_number().over(order))
    parts = max(1, -(-total // (shards * part_rows)))
    sent = local.join(matrix.select("unit", ends.alias("ends")), "unit").select(
        "doc", "at", F.size(F.filter("ends", lambda e: e < F.col("_n"))).alias("shard"), uniform(F.col("at"), seed, "second").alias("_second"))
    sent = sent.withColumn("part", F.floor(F.col("_second") * parts)).repartition("shard", "part")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "part").agg(F.count("*").alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    again = Window.partitionBy("shard", "part").orderBy("_second", "at")
    return sent.withColumn("_n", F.row_number().over(again)).join(starts, ["shard", "part"]).select(
        "doc", "shard", (F.col("_start") + F.col("_n") - 1).cast("bigint").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 1) -> str:
    """One folder per shard, whose files hold runs of the shard's order; returns the name of the folder column,
    ``shard`` with as many underscores before it as keep it apart from the columns of ``docs``."""
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    placed = shuffle_into_shards(docs, shards, seed)
    (placed.withColumn("run", F.floor(F.col("slot") / PART_ROWS)).repartition("shard", "run").sortWithinPartitions("shard", "slot")
     .select("doc.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path))
    return name


def report(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_into_shards(rows).select(
        "doc.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
