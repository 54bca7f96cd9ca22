"""Category recursion and landed JSON files."""

import json

from gondola.operators import catalog
from gondola.plans.catalog import categories
from gondola.sources import landed
from gondola.sources.derive import Tables

TREE = "id bigint, name string, slug string, parent_id bigint"


def test_tree_of_any_depth(spark):
    chain = spark.createDataFrame([(i, f"n{i}", f"n{i}", i - 1 if i else None) for i in range(120)], TREE)
    counts = spark.createDataFrame([("n4", 7)], "slug string, product_count bigint")
    tree = {r["slug"]: r for r in catalog.category_tree(chain, counts).collect()}
    assert len(tree) == 120 and tree["n119"]["depth"] == 119
    assert tree["n4"]["path"] == "n0/n1/n2/n3/n4" and tree["n4"]["product_count"] == 7
    assert tree["n20"]["path"] == "/".join(f"n{i}" for i in range(21)) and tree["n20"]["product_count"] == 0


def test_circles_and_orphans_are_rows(spark):
    rows = [(1, "a", "a", None), (2, "b", "b", 1), (3, "c", "c", 4), (4, "d", "d", 5), (5, "e", "e", 3), (6, "f", "f", 4),
            (7, "g", "g", 7), (8, "h", "h", 99), (9, "i", "i", 8)]
    frame = spark.createDataFrame(rows, TREE)
    got = {r["id"]: r["problem"] for r in catalog.category_problems(frame).collect()}
    assert got == {3: "cycle", 4: "cycle", 5: "cycle", 6: "cycle", 7: "cycle", 8: "orphan", 9: "orphan"}
    counts = spark.createDataFrame([], "slug string, product_count bigint")
    assert {r["id"] for r in catalog.category_tree(frame, counts).collect()} == {1, 2}
    assert catalog.category_problems(frame.limit(0)).count() == 0


def test_artifact_files_with_many_candidates_and_bad_ones(spark, tmp_path):
    wrapper = {"sources": ["Shop "], "coverage": {"mode": "full", "surface": "Category"}, "candidates": [
        {"ean": "1"}, {"ean": "2", "source": "Other", "surface": "SEARCH"}, {"skuId": "s3", "source": " "}]}
    files = {
        "good.json": "﻿" + json.dumps(wrapper, indent=2), "list.json": json.dumps([{"name": "x"}, {"source": "a", "surface": "b", "url": "u"}]),
        "many.json": json.dumps({**wrapper, "sources": ["a", "b"]}), "clash.json": json.dumps({**wrapper, "coverage": {"mode": "full", "surface": "s", "modes": ["other"]}}),
        "bare.json": json.dumps({"candidates": [{"ean": "9"}]}), "cut.json": json.dumps(wrapper)[:50], "none.json": '{"candidates": 5}', "empty.json": "  ", "text.json": "hello"}
    (tmp_path / "deep").mkdir()
    for name, text in files.items():
        (tmp_path / ("deep" if name == "list.json" else ".") / name).write_text(text)
    documents = landed.read_documents(spark, str(tmp_path), pattern="*.json")
    rows = {(r["file"], r["pos"]): r for r in landed.artifact_candidates(documents).collect()}
    picked = {k: (r["source"], r["surface"], r["errors"]) for k, r in rows.items()}
    assert picked["good.json", 0] == ("shop", "category", []) == picked["good.json", 2]
    assert picked["good.json", 1] == ("other", "search", [])
    assert (rows["good.json", 2]["sku_id"], rows["good.json", 1]["ean"]) == ("s3", "2")
    assert picked["list.json", 0] == (None, None, ["source_missing", "surface_missing"]) and picked["list.json", 1] == ("a", "b", [])
    assert picked["many.json", 0] == (None, "category", ["wrapper_source"])
    assert picked["clash.json", 0] == ("shop", None, ["wrapper_coverage_conflict"]) and picked["clash.json", 1] == ("other", "search", [])
    assert picked["bare.json", 0] == (None, None, ["wrapper_source", "wrapper_coverage"])
    bad = {r["file"]: (r["reason"], r["bytes"]) for r in landed.quarantined_artifacts(documents).collect()}
    assert bad == {"cut.json": ("not_json", 50), "none.json": ("no_candidates", 17), "empty.json": ("empty", 2), "text.json": ("not_json", 5)}
    assert {f for f, _ in rows} | set(bad) == set(files)  # nothing is lost


def test_payload_lines_and_their_quarantine(spark, tmp_path):
    deep = '{"a":[' * 12 + '{"productName":"low"}' + "]}" * 12
    (tmp_path / "crawl.jsonl").write_text("\n".join(['{"productName":"p","items":[]}', "", "{cut", "[]", deep]) + "\n")
    lines = landed.read_documents(spark, str(tmp_path), whole=False)
    assert sorted(r["record"] for r in landed.payload_records(lines).collect()) == ['{"items":[],"productName":"p"}', '{"productName":"low"}']
    bad = {r["excerpt"][:4]: r["reason"] for r in landed.quarantined_documents(lines).collect()}
    assert bad == {"{cut": "not_json", "[]": "no_products", '{"a"': "deep"}


def test_recursion_is_a_loop_over_joins(spark):
    plan = catalog.category_descent(categories(Tables(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().executedPlan().toString()
    assert "UnionLoop" in plan and "CartesianProduct" not in plan
