"""Registered training-data queries and, where SQL can state them, the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import session
from . import decontam, langid, lines, mixing, neardup, phrases, pii, ppm, prefixhash, sharding, suffix, toxicity, whitening

#: Rows of an Arrow batch: texts are long, and a batch must fit a small Python worker.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = session.tune(spark), sf_dir
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    "op1_suffix_dedup": lambda t: suffix.report(t.documents),
    "op2_ppm_score": lambda t: ppm.report(t.documents),
    "op3_decontamination": lambda t: decontam.report(t.documents, t.benchmark),
    "op4_near_duplicates": lambda t: neardup.report(t.documents),
    "op5_toxicity": lambda t: toxicity.report(t.documents, t.labels),
    "op6_line_dedup": lambda t: lines.report(t.documents),
    "op7_language": lambda t: langid.report(t.documents),
    "op8_fingerprints": lambda t: prefixhash.report(t.documents),
    "op9_source_mix": lambda t: mixing.report(t.documents, t.labels),
    "op10_pii": lambda t: pii.report(t.documents),
    "op11_collocations": lambda t: phrases.report(t.documents),
    "op12_whitening": lambda t: whitening.report(t.embeddings),
    "op13_sharding": lambda t: sharding.report(t.documents),
}
SQL: dict[str, str] = {"op1_suffix_dedup": suffix.SQL, "op4_near_duplicates": neardup.SQL, "op6_line_dedup": lines.SQL, "op9_source_mix": mixing.SQL,
                       "op11_collocations": phrases.SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run  # it imports this module's Inputs

    found = {name: (lambda spark, sf_dir, build=build: build(Inputs(spark, sf_dir))) for name, build in QUERIES.items()}
    return found | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
