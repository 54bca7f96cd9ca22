"""What a task holds and does must not grow faster than the input."""

from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from gondola.functions import numeric, text
from gondola.operators import identity
from gondola.sources import landed, payloads

ODD = [
    '{"productName":"a","items":[{"id":1}]}',
    '{"a":{"b":[{"items":[]},{"productName":"x","c":{"items":null}}]}}',
    '{"product\\u004eame":"x","a":{"b":{"items":[{"productName":"y"}]}}}',
    '{"a":"items","b":"\\"items\\"","c":{"d":"productName"},"e":[[{"productName":"z"}]]}',
    '[' * 14 + '{"items":[1]}' + ']' * 14, '{"data":[]}', '{"cut":', '"items"', '', None,
    '{"a":' * 9 + '"[[[[[["' + '}' * 9, '{"a":' * 9 + '[[1]]' + '}' * 9, '{"a":' * 10 + '{}' + '}' * 10, '[' * 10 + ']' * 10, '[' * 11 + ']' * 11]


def test_pruned_walk_finds_what_the_whole_walk_finds(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, raw string")
    whole = payloads._walk_all(payloads._root(), payloads._is_product, payloads._children, 10)
    deep = payloads._walk(payloads._root(), payloads._is_product, payloads._children, 10)["deeper"]
    got = rows.select(
        "i", F.transform(whole, lambda v: F.to_json(v)).alias("hits"), (F.size(whole) > 0).alias("any"), payloads.has_products().alias("has"),
        deep.alias("deep"), payloads.deeper_than(10).alias("deeper")).collect()
    found = {i: [] for i in range(len(ODD))}
    for r in payloads.find_product_records(rows).orderBy("i", "pos").collect():
        found[r.i].append(r.record)
    for r in got:
        assert found[r.i] == r.hits and r["has"] == r["any"] and r.deeper == r.deep, ODD[r.i]
    assert any(r.deep for r in got) and len(found[2]) == 3


def test_normalized_values_are_worked_out_once(spark):
    rows = spark.createDataFrame([('{"productName":"a"}', "https://m.example.com")], "record string, base_url string")
    plan = payloads.normalize_payloads(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\d{8,14}") == 1 and plan.count("arroz|") + plan.count("lower(") < 30


def test_fast_paths_keep_values(spark):
    texts = ["", " a ", "a  b", "<b>x</b>", "a b", "a b", "\ta", "é", "a<b", None, "a b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    spaced = F.regexp_replace(F.regexp_replace("t", "<[^>]*>", " "), r"(?U)\s+", " ")
    for r in rows.select(text.strip_html(F.col("t")).alias("a"), F.when(F.length("t") > 0, F.trim(spaced)).alias("b")).collect():
        assert r.a == r.b
    numbers = spark.createDataFrame([(t,) for t in ("1,5", "1,2,3", "", " 7 ", "x", "1e999", None, "-.5")], "t string")
    assert [r[0] for r in numbers.select(numeric.loose_number(F.col("t"))).collect()] == [1.5, None, 0.0, 7.0, None, None, None, -0.5]


def test_rows_without_identity_are_spread(spark):
    """Keyless rows of a left join all have one hash, so they need a second join key of their own."""
    rows = spark.range(4000).select("id", F.lit(None).cast("string").alias("k"), F.lit("x").alias("other"))
    rows = rows.unionByName(spark.range(4000, 4100).select("id", (F.col("id") % 50).cast("string").alias("k"), F.lit("x").alias("other")))
    held = {n: spark.conf.get(n) for n in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        marked = identity.duplicate_numbering(rows, F.col("k"), F.col("id")).withColumn("task", F.spark_partition_id()).cache()
        sizes = [r["count"] for r in marked.groupBy("task").count().collect()]
        assert marked.filter("is_duplicate").count() == 50 and marked.count() == 4100 and max(sizes) < 1500
    finally:
        for n, v in held.items():
            spark.conf.set(n, v)


def test_partitions_follow_the_size_of_a_shuffle(spark):
    """More rows make more tasks, not larger ones, whatever number of shuffle partitions the session has (8 here)."""
    queries = entry_point.queries()
    queries["a09_seeded_stores"](spark, "/root/testdata/sf0.001")
    rows = spark.range(3_000_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).repartition("id")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() >= 1
    assert rows.rdd.getNumPartitions() > 12


def line_scans(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet")


def test_repeated_inputs_are_worked_out_once(spark):
    """Current prices, staged winners and guards that a query reads several times come from one pass over the lines."""
    for name in ("j13_applied_refresh", "j14_apply_races", "j15_rollback_report", "j04_second_batch_adds_nothing", "k04_post_run_audit"):
        frame = entry_point.queries()[name](spark, "/root/testdata/sf0.001")
        assert line_scans(frame) == 0, name
    plan = entry_point.queries()["j13_applied_refresh"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("price_delta_too_large") <= 2  # the list and its test, of one filter


def test_landed_documents_are_parsed_once(spark):
    documents = spark.createDataFrame([("f", 1, "{}", "x")], "file string, bytes bigint, body string, other string")
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    artifacts = plan(landed.artifact_candidates(documents))
    # wrapper defaults stand below the step that makes a row per candidate
    assert artifacts.count("wrapper_coverage_conflict") == 1
    assert artifacts.index("posexplode") < artifacts.index("wrapper_coverage_conflict")
    assert plan(landed.quarantined_documents(documents)).lower().count("parsejson") + plan(landed.quarantined_documents(documents)).count("parse_json") <= 1


def test_partitioned_writes_work_their_rows_out_once_and_keep_files_few(spark, tmp_path):
    from gondola.sources import sinks

    worked = spark.sparkContext.accumulator(0)

    def counting(parts):
        for part in parts:
            worked.add(len(part))
            yield part

    rows = spark.range(6000).selectExpr("id", "timestamp_seconds(id % 40 * 86400) AS created_at").mapInPandas(counting, "id long, created_at timestamp")
    before = {name: spark.conf.get(name) for name in sinks.WRITE_TASKS}
    sinks.append_staging(rows, str(tmp_path))
    assert worked.value == 6000  # a range exchange reads them a first time to find its bounds
    assert {name: spark.conf.get(name) for name in sinks.WRITE_TASKS} == before
    assert len(list(tmp_path.glob("staging_product/load_day=*/*.parquet"))) == 40
    assert spark.read.parquet(f"{tmp_path}/staging_product").selectExpr("count(*)", "count(DISTINCT id)", "count(DISTINCT load_day)").first()[:] == (6000, 6000, 40)
