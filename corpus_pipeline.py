"""From raw documents to a training mix in five stages over Spark tables.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``; the last returns the mixed documents with the
words taken of each. Stages are written as Parquet in the folder that
``spark.checkpoint.dir`` names and read again, so a lost executor never costs
more than the stage it was running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import decontam, lines, mixing, neardup, toxicity
from gondola.llm.queries import Inputs
from gondola.llm.shared import stored


def carried(docs: DataFrame, *names: str) -> DataFrame:
    """doc_id, text and the named columns, and the whole rows in a struct ``row``: whatever other columns are called
    (``size``, ``_score``, ``a.b``), they travel there and clash with nothing."""
    return docs.select("doc_id", "text", *names, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents whose toxicity reaches 0.5 go.

    Null and empty texts have no sentence and stay; rows that share an id are judged by their own texts.
    """
    labels = Inputs(spark, sf_dir).labels
    model = toxicity.fit(docs.where(~toxicity.held_out()), labels.where(~toxicity.held_out()))
    return toxicity.score(carried(docs), model).where("_score < 0.5").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: lines that stand in an earlier document go; every document stays, with its new length.

    A null text stays null; rows that share an id take no lines from each other.
    """
    Inputs(spark, sf_dir)
    done = lines.drop_repeated_lines(carried(docs))
    row = F.col("row").withField("text", F.col("_kept"))
    return done.select(row.withField("n_chars", F.length("_kept").cast(docs.schema["n_chars"].dataType)).alias("row")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of documents alike by 0.8 of their five-word shingles, the least id stays.

    Texts without words are like nothing and stay, as do rows with a null id; rows that share an id go or stay together.
    """
    Inputs(spark, sf_dir)
    return neardup.drop_near_duplicates(carried(docs), width=5, percent=80).select("row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a test item or an edited copy of one go; null and empty texts stay."""
    return decontam.drop_contaminated(carried(docs), Inputs(spark, sf_dir).benchmark).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the documents of the mix, each with the words taken of it (over its size: several epochs).

    Texts without words are not taken; a null source is one of its own. size, source_size, target and taken come behind the
    columns of ``docs``, with an underscore before those that ``docs`` has already.
    """
    mixed = mixing.mix(carried(docs, "source"), mixing.quality_weights(Inputs(spark, sf_dir).labels), carry=True).where("taken > 0")
    added = []
    for name in ("size", "source_size", "target", "taken"):
        free = name
        while free in docs.columns:
            free = f"_{free}"
        added.append(F.col(name).alias(free))
    return mixed.select("doc.row.*", *added)


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies),
          ("decontamination", drop_benchmark), ("source_mix", mix_sources)]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Inputs(spark, sf_dir).documents
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
