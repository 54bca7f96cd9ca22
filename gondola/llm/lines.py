"""Line dedup across documents, with DataFrame functions only.

A line's key (trimmed, A-Z lower-cased) travels as a 128-bit hash. The first
occurrence of a key is the minimum document over its hash, taken with map-side
partial sums, so a line that stands in a third of all documents reaches its
reducer as one row per map task. Occurrences behind the first come back as one
sparse bitmap per document; texts never meet the hashes and are read once more
only to apply the bitmaps.

Cases: null or empty texts are one empty line. Rows with a null id belong to no
document and keep every line. Rows that share an id are one document: each gets
its own result, and none loses a line to another. Other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; ``lower`` itself is right (and fast) only where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(_id, _text_key, dropped): lines to drop, as 64-bit words {word number: bits}, of documents that lose any."""
    held = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_text_key"),
                       F.posexplode(lines_of(F.col(text_col))).alias("_pos", "_line")).where(F.col("_id").isNotNull())
    keyed = held.withColumn("_key", line_key(F.col("_line"))).where(F.length("_key") >= min_chars).select(
        "_id", "_text_key", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("line"), F.col("_key")).alias("_h2"))
    firsts = keyed.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where(
        F.col("_first") < F.col("_last")).drop("_last")
    later = keyed.join(firsts, ["_h1", "_h2"]).where(F.col("_id") > F.col("_first"))
    bit = F.expr("shiftleft(1L, _pos % 64)")
    words = later.groupBy("_id", "_text_key", F.expr("_pos div 64").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("_id", "_text_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``docs`` with ``_kept`` (text without repeated lines; null where the text is null), ``_n_lines``, ``_n_dropped``."""
    keys = keep_bitmaps(docs, id_col, text_col, min_chars)
    text = F.col(f"_doc.{text_col}")
    left = docs.select(F.struct("*").alias("_doc")).withColumns({"_doc_id": F.col(f"_doc.{id_col}"), "_doc_key": F.xxhash64(text)})
    on = (F.col("_doc_id") == F.col("_id")) & (F.col("_doc_key") == F.col("_text_key"))
    lines = lines_of(text)
    stays = F.filter(lines, lambda x, i: (F.coalesce(
        F.element_at("dropped", F.floor(i / 64).cast("int")), F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64))) == 0)
    count = F.aggregate(F.map_values("dropped"), F.lit(0).cast("long"), lambda a, b: a + F.bit_count(b))
    added = {"_kept": F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(stays, "\n")),
             "_n_lines": F.size(lines).cast("long"), "_n_dropped": F.coalesce(count, F.lit(0).cast("long"))}
    joined = left.join(keys.hint("shuffle_hash"), on, "left").select("_doc", *[v.alias(k) for k, v in added.items()])
    return joined.select(*[F.col(f"_doc.{c}").alias(c) for c in docs.columns if c not in added], *added)


def report(docs: DataFrame) -> DataFrame:
    done = drop_repeated_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                       F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT doc_id, pos, line, first IS NOT NULL AND doc_id > first AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
