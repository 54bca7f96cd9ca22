"""The pipeline's stages on planted documents, and its result on the given table."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from gondola.llm.queries import queries

SF_DIR = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = list(queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_stages_act_and_keep_the_columns(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rng = random.Random(0)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    body, shared = prose(200), "this very line stands in two documents"
    planted = [(10_000, body), (10_001, body + " " + prose(2)), (10_002, prose(50) + " " + item), (10_003, prose(40) + "\n" + shared),
               (10_004, prose(40) + "\n" + shared), (10_005, None), (10_006, "")]
    rows = spark.createDataFrame([(i, t, "en", "src1", len(t) if t else None) for i, t in planted], documents.schema)
    docs = documents.unionByName(rows)
    before = docs.count()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "source_mix":
            assert docs.schema.names == documents.schema.names and [f.dataType for f in docs.schema] == [f.dataType for f in documents.schema]
    assert {i for i, _ in planted} <= set(seen["toxicity"]) and len(seen["toxicity"]) <= before
    assert set(seen["line_dedup"]) == set(seen["toxicity"])
    assert seen["line_dedup"][10_003].text.endswith(shared) and shared not in seen["line_dedup"][10_004].text
    assert seen["line_dedup"][10_004].n_chars == len(seen["line_dedup"][10_004].text) and seen["line_dedup"][10_005].text is None
    assert 10_000 in seen["near_dedup"] and 10_001 not in seen["near_dedup"]
    assert 10_002 in seen["near_dedup"] and 10_002 not in seen["decontamination"]
    assert {10_003, 10_004, 10_005, 10_006} <= set(seen["decontamination"])
    assert all(r.taken > 0 for r in seen["source_mix"].values()) and set(seen["source_mix"]) <= set(seen["decontamination"])
    empty = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF_DIR)
    assert empty.count() == 0


def test_run_is_repeatable(spark):
    one, two = (corpus_pipeline.run(spark, SF_DIR).toPandas().sort_values("doc_id", ignore_index=True) for _ in range(2))
    assert len(one) and one.equals(two)


def test_clashing_columns_pass_through_all_stages(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = ("size", "target", "taken", "_score", "_worst", "_kept", "a.b", "row", "doc", "id", "_tie", "component", "_gone")
    docs = documents
    for k, name in enumerate(extra):
        docs = docs.withColumn(name, F.col("doc_id") + k)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    rows = docs.collect()
    assert len(rows) and docs.columns == [*documents.columns, *extra, "_size", "source_size", "_target", "_taken"]
    assert all(r[name] == r["doc_id"] + k for r in rows for k, name in enumerate(extra))
