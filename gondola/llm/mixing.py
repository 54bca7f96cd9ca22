"""Mixing sources to target weights by Efraimidis-Spirakis keys, with DataFrame functions only.

Every document draws an exponential key -ln(u)/w, u from a hash of its id and w
from its quality label. A source first gives complete epochs of all its
documents, then documents by ascending key until the rest of its word budget is
met. Prefix sums never sort a whole source in one task: keys fall into 4096
buckets of about equal probability, bucket totals are prefix-summed on their
own, and a window only orders the documents inside a bucket.

Cases: null texts have size 0; a null source is a value of its own and comes
last; repeated rows are documents of their own. Reruns agree: u is a hash of the
id, or of the whole row where the id is null, and rows that share an id stand in
the order of a hash of the row. With ``carry`` the rows travel in a struct, so
their column names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_weights(labels: DataFrame) -> DataFrame:
    """(_labelled, _weight): 2 for good documents, 0.5 for bad ones; all others weigh 1."""
    best = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("quality").alias("q"))
    return best.where(F.col("q").isNotNull()).select("_labelled", F.when(F.col("q") == 1, 2.0).otherwise(0.5).alias("_weight"))


def exponential_key(id_text: Column, weight: Column) -> Column:
    u = (F.conv(F.substring(F.md5(F.coalesce(id_text, F.lit(""))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(_null, _src, source_size) -> with target: all words shared by weight, none above ``most`` times its source.

    The repeated resharing ends where a common level L gives min(cap, weight * L)
    to each source; in ascending order of cap / weight, a source is capped as long
    as L over the rest would exceed it. One row per source only.
    """
    rank = F.row_number().over(Window.orderBy("_null", "_src"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), "_null", "_src")
    everything = Window.partitionBy()
    rows = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most)
    rows = rows.withColumns({
        "_left": F.sum("source_size").over(everything) - F.coalesce(
            F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_open": F.sum("_w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    rows = rows.withColumn("_level", F.col("_left") / F.col("_open")).withColumn(
        "_capped", F.col("_cap") < F.col("_w") * F.col("_level"))
    level = F.min(F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("_w"), "_null", "_src", "_level"))).over(everything)
    return rows.withColumn("_final", level["_level"]).select("_null", "_src", "source_size", F.when(
        F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_final")).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", carry: bool = False) -> DataFrame:
    """One row per document: its id and source, size, source_size, target, taken (words, repeats counted).

    With ``carry``, all columns of ``docs`` come along in a struct ``doc``.
    """
    id_ = F.col(id_col)
    named = lambda c: F.col(f"`{c}`")
    extra_columns = [F.struct(*[named(c) for c in docs.columns]).alias("doc")] if carry else []
    # rows that also agree in this are the same to the mix, in whatever order they come
    tie = F.xxhash64(*[named(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    rows = docs.select(id_.alias("_id"), *extra_columns, tie.alias("_tie"), F.col(source_col).alias("source"), F.col(source_col).isNull().alias("_null"),
                       F.coalesce(F.col(source_col), F.lit("")).alias("_src"), word_count(F.col(text_col)).alias("size"))
    if quality is None:
        rows = rows.withColumn("_weight", F.lit(1.0))
    else:
        rows = rows.join(quality, F.col("_id") == F.col("_labelled"), "left").drop("_labelled").withColumn(
            "_weight", F.coalesce("_weight", F.lit(1.0)))
    rows = rows.withColumn("_key", exponential_key(
        F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("~"), F.col("_tie").cast("string"))), F.col("_weight")))
    rows = rows.withColumn("_bucket", F.floor(BUCKETS * (1 - F.exp(-F.col("_key")))).cast("int")).repartition("_null", "_src", "_bucket")
    totals = rows.groupBy("_null", "_src", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("_null", "_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    targets = source_targets(totals.groupBy("_null", "_src").agg(F.sum("_sum").alias("source_size")))
    starts = starts.join(targets, ["_null", "_src"]).drop("_sum")
    inside = Window.partitionBy("_null", "_src", "_bucket").orderBy("_key", "_id", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_upto", F.sum("size").over(inside)).join(starts, ["_null", "_src", "_bucket"])
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_EPOCHS))).otherwise(0)
    placed = placed.withColumn("_epochs", epochs.cast("long"))
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    middle = F.col("_ahead") + F.col("_upto") - F.col("size") / 2
    extra = F.when((F.col("_epochs") < MAX_EPOCHS) & (middle <= rest), F.col("size")).otherwise(F.lit(0))
    return placed.select(*(["doc"] if carry else []), F.col("_id").alias(id_col), "source", "size", "source_size", "target",
                         (F.col("_epochs") * F.col("size") + extra).cast("long").alias("taken"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source"), quality_weights(labels)).drop("source")


SQL = r"""
WITH quality AS (SELECT doc_id, CASE WHEN max(quality) = 1 THEN 2.0::double ELSE 0.5::double END AS w
                 FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) IS NOT NULL),
sized AS (
  SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size,
         -ln((('0x' || substr(md5(cast(d.doc_id AS varchar)), 1, 12))::bigint + 0.5::double) / 281474976710656::double)
           / coalesce(w, 1.0::double) AS key
  FROM documents d LEFT JOIN quality q ON q.doc_id = d.doc_id),
sources AS (
  SELECT source, sum(size)::bigint AS n, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source),
leveled AS (
  SELECT *, 3 * n AS cap, ((SELECT sum(n) FROM sources) - coalesce(sum(3 * n) OVER (
              ORDER BY 3 * n / w::double, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::double
            / (sum(w) OVER (ORDER BY 3 * n / w::double, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::double AS level
  FROM sources),
final AS (SELECT level FROM leveled WHERE NOT (cap < w * level) ORDER BY cap / w::double, source IS NULL, source LIMIT 1),
targets AS (
  SELECT source, n AS source_size, CASE WHEN cap < w * level THEN cap::double ELSE w * (SELECT level FROM final) END AS target FROM leveled),
placed AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::bigint ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size / 2.0::double AS middle
  FROM sized s JOIN targets t ON t.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN epochs < 3 AND middle <= target - epochs * source_size THEN size ELSE 0 END)::bigint AS taken
FROM placed"""
