"""Keyed stream state, jump functions of the cool-down, and the bucketed table."""

import random
import tempfile
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gondola.operators import merge
from gondola.plans.streams import STATE_STORE
from gondola.sources import versions
from gondola.streaming import jobs

PRICES = "id string, key bigint, t bigint, price decimal(10,2), list_price decimal(10,2)"


@pytest.fixture
def store(spark):
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)


def land(spark, root, number, rows):
    spark.createDataFrame(rows, PRICES).withColumn("scraped_at", F.timestamp_seconds("t")).drop("t").coalesce(1).write.parquet(f"{root}/in/f{number:02d}")


def run_prices(spark, root, buckets=4):
    schema = spark.createDataFrame([], PRICES).withColumn("scraped_at", F.timestamp_seconds("t")).drop("t").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
    jobs.run_to_parquet(jobs.price_changes(stream, buckets), f"{root}/job").awaitTermination()
    return {r["id"]: r for r in spark.read.parquet(f"{root}/job/out").collect()}


def expected_changes(batches):
    last, out = {}, []
    for batch in batches:
        for id_, key, t, price, listed in sorted(batch, key=lambda r: (r[2], r[0])):
            if key in last and (t, id_) <= last[key][0]:
                continue  # late: neither a change nor a new stored value
            if key not in last or last[key][1] != (price, listed):
                out.append(id_)
            last[key] = ((t, id_), (price, listed))
    return out


def test_price_changes_over_batches_restart_and_late_rows(spark, store):
    from decimal import Decimal as D

    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rng = random.Random(1)
    price = lambda: D(rng.randrange(3)) if rng.random() < 0.9 else None
    rows = [(f"{i:05d}", rng.randrange(6) - 2, i // 2, price(), D("1.50")) for i in range(600)]
    batches = [rows[:200], rows[200:400], rows[400:]]
    late = [(f"L{i:03d}", rng.randrange(6) - 2, rng.randrange(150), D(9), None) for i in range(40)]
    batches[1] = batches[1] + late  # older than what the first batch stored
    batches[2] = batches[2] + [("L900", 3, 5, D(7), D(7)), ("L901", 77, 5, D(7), D(7))]  # late for 3, first for 77
    for number, batch in enumerate(batches[:2]):
        rng.shuffle(batch)
        land(spark, root, number, batch)
    first = run_prices(spark, root)
    assert sorted(first) == sorted(expected_changes(batches[:2]))
    land(spark, root, 2, batches[2])
    got = run_prices(spark, root)  # continues from the checkpoint
    assert sorted(got) == sorted(expected_changes(batches))
    assert "L900" not in got and "L901" in got and not any(i.startswith("L0") and i in expected_changes(batches[:1]) for i in got)
    assert (got["L901"]["price"], got["L901"]["list_price"]) == (D("7.00"), D("7.00"))


def test_price_changes_keep_a_state_row_per_block_of_keys(spark, store):
    from decimal import Decimal as D

    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rng = random.Random(2)
    keys = [k for k in range(-300, 1700)]
    # two rows of a second are ordered by their ids, in a batch and against the stored row
    batches = [[(f"{n}{i:05d}", k, rng.randrange(3), D(rng.randrange(3)), D(1)) for i, k in enumerate(keys * 2) if n == 0 or rng.random() < 0.2] for n in (1, 0)]
    blocks = len({int(k / 256) for k in keys})
    schema = spark.createDataFrame([], PRICES).withColumn("scraped_at", F.timestamp_seconds("t")).drop("t").schema
    for number, batch in enumerate(batches):
        rng.shuffle(batch)
        land(spark, root, number, batch)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
        query = jobs.run_to_parquet(jobs.price_changes(stream), f"{root}/job")
        query.awaitTermination()
        state = [s for p in query.recentProgress for s in p["stateOperators"]]
        assert state and all(0 < s["numRowsTotal"] <= blocks for s in state)
    assert sorted(r["id"] for r in spark.read.parquet(f"{root}/job/out").collect()) == sorted(expected_changes(batches))


def greedy(seconds, cooldown, last=None):
    sent = []
    for s in sorted(set(seconds)):
        if last is None or s - last >= cooldown:
            sent.append(s)
            last = s
    return sent


@pytest.mark.parametrize("cooldown, span, n", [(10, 4000, 900), (10, 40, 40), (1800, 400_000, 600), (7, 100_000, 90), (3, 300, 300)])
def test_jump_functions_send_what_a_loop_sends(spark, cooldown, span, n):
    rng = random.Random(cooldown + n)
    rows = [(f"s{i % 3}", rng.randrange(-span // 4, span)) for i in range(n)] + [("one", 5), ("edge", 0), ("edge", cooldown), ("edge", 2 * cooldown - 1)]
    rows = sorted(set(rows))
    last = {"s1": span // 3, "one": 5 - cooldown, "gone": 9}
    frame = spark.createDataFrame(rows, "source_slug string, second bigint").repartition(4)
    state = spark.createDataFrame(list(last.items()), "source_slug string, last_second bigint")
    for known in (None, state):
        got = defaultdict(list)
        for r in jobs.cooled_down(frame, cooldown, known).collect():
            got[r["source_slug"]].append(r["second"])
        seconds = defaultdict(list)
        for s, second in rows:
            if known is None or s not in last or second >= last[s] + cooldown:
                seconds[s].append(second)
        want = {s: greedy(v, cooldown, last.get(s) if known is not None else None) for s, v in seconds.items()}
        assert {s: sorted(v) for s, v in got.items()} == {s: v for s, v in want.items() if v}


def test_failure_alerts_across_batches_without_python(spark):
    log = [(i, "s" if i % 4 else "r", i * 400, i % 11 == 0) for i in range(80)]
    df = spark.createDataFrame(log, "id bigint, source_slug string, t bigint, is_healthy boolean").withColumn("checked_at", F.timestamp_seconds("t"))
    streak, last, want = Counter(), {}, []
    for i, source, t, good in log:
        streak[source] = 0 if good else streak[source] + 1
        if streak[source] >= 2 and (source not in last or t - last[source] >= 1800):
            want.append((i, streak[source]))
            last[source] = t
    state, got = None, []
    for low, high in ((0, 25), (25, 26), (26, 80)):
        rows = jobs.failure_alerts_of_batch(df.filter((F.col("id") >= low) & (F.col("id") < high)), state)
        assert "InPandas" not in rows._jdf.queryExecution().executedPlan().toString()
        kinds = rows.collect()
        got += [(r["id"], r["failures"]) for r in kinds if r["kind"] == "alert"]
        state = spark.createDataFrame([r for r in kinds if r["kind"] == "state"], rows.schema)
    assert sorted(got) == want
    assert {r["source_slug"]: (r["failures"], r["last_second"]) for r in state.collect()} == {s: (streak[s], last[s]) for s in streak}


# -- ids and the bucketed table

def test_created_ids_differ_for_every_text(spark):
    texts = ["012345678905", "0012345678905", "12345678905", "00000000", "000000000", "00000000000000", "99999999999999", "99999999", "100000000",
             "12345678\n", "1234567", "123456789012345", "abc45678", "", None, "１２３４５６７８"]
    rows = spark.createDataFrame([(t, s) for t in texts for s in (0, 3, 65534)], "ean string, store bigint").select(
        "ean", merge.created_id(F.col("ean"), F.col("store")).alias("id")).collect()
    good = [r["id"] for r in rows if r["ean"] and r["ean"].isascii() and r["ean"].isdigit() and 8 <= len(r["ean"]) <= 14]
    assert len(good) == 27 == len(set(good)) and all(-(1 << 63) <= i < 0 for i in good)
    assert {r["id"] for r in rows if not (r["ean"] and r["ean"].isascii() and r["ean"].isdigit() and 8 <= len(r["ean"]) <= 14)} == {None}


CURRENT = ("id bigint, product_ean string, supermarket_id bigint, price decimal(10,2), list_price decimal(10,2), reference_price decimal(10,2), "
           "reference_unit string, is_available boolean, sku_id string, seller_id string, product_url string, last_checked_at timestamp")
NOW = "2001-11-05 00:00:00"


def current_rows(spark, n=400):
    return spark.range(n).select(
        "id", F.lpad((F.col("id") % 100).cast("string"), 13, "0").alias("product_ean"), F.floor(F.col("id") / 100).alias("supermarket_id"),
        *[F.expr(f"CAST({v} AS {k}) AS {c}") for c, k, v in (
            ("price", "decimal(10,2)", "id"), ("list_price", "decimal(10,2)", "NULL"), ("reference_price", "decimal(10,2)", "NULL"), ("reference_unit", "string", "NULL"),
            ("is_available", "boolean", "true"), ("sku_id", "string", "id"), ("seller_id", "string", "1"), ("product_url", "string", "NULL"))],
        F.lit("2001-01-01").cast("timestamp").alias("last_checked_at"))


def batch_rows(spark, rows):
    return spark.createDataFrame(rows, "ean string, source_slug string, price double").select(
        "ean", "source_slug", F.col("price").cast("decimal(18,2)").alias("price"), *[F.lit(None).cast(k).alias(c) for c, k in (
            ("list_price", "decimal(10,2)"), ("reference_price", "decimal(10,2)"), ("reference_unit", "string"))],
        F.lit(True).alias("is_available"), *[F.lit(None).cast("string").alias(c) for c in ("sku_id", "seller_id", "product_url")])


def files_of(root):
    return {p.relative_to(root): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    root = str(tmp_path / "current")
    stores = spark.createDataFrame([(i, f"m{i}") for i in range(5)], "id bigint, slug string")
    state = current_rows(spark)
    first = versions.create(state, root, merge.KEY, "supermarket_id", buckets=8)
    before = files_of(root)
    assert len(first.writes) == 32 and versions.read(spark, root).count() == 400
    batch = batch_rows(spark, [("0000000000007", "m2", 1.5), ("0000000000008", "m2", 2.5), ("012345678905", "m3", 3.0), ("0012345678905", "m3", 4.0),
                               ("0000000000001", "m4", 5.0), ("not an ean", "m1", 6.0), ("0000000000009", "unknown", 7.0)])
    places = versions.touched(batch.join(stores.select(F.col("slug").alias("source_slug"), F.col("id").alias("supermarket_id")), "source_slug").withColumn("product_ean", F.col("ean")), first)
    after = merge.merge_current(root, batch, stores, NOW, first.version)
    assert after.version == 1 and {k for k, w in after.writes.items() if first.writes.get(k) != w} <= places
    assert all(after.writes[k] == w for k, w in first.writes.items() if k not in places) and len(places) <= 6
    assert {k: v for k, v in files_of(root).items() if k in before} == before  # nothing written before is touched
    got = sorted(map(tuple, versions.read(spark, root).collect()), key=str)
    want = merge.upsert_current(state, batch, stores, NOW).drop("action").select(*state.columns).collect()
    assert got == sorted(map(tuple, want), key=str) and len(got) == 403
    assert sorted(map(tuple, versions.read(spark, root, first).collect())) == sorted(map(tuple, state.collect()))  # the old version stays
    refused = merge.refused_creations(batch, state, stores).collect()
    assert [(r["product_ean"], r["supermarket_id"]) for r in refused] == [("not an ean", 1)]
    with pytest.raises(ValueError, match="version 1"):
        merge.merge_current(root, batch, stores, NOW, 0)
    assert merge.merge_current(root, batch.limit(0), stores, NOW).version == 1
    again = merge.merge_current(root, batch, stores, NOW)
    assert again.version == 2 and sorted(map(tuple, versions.read(spark, root).collect()), key=str) == got
    gone = versions.vacuum(spark, root, keep=1)
    assert gone and sorted(map(tuple, versions.read(spark, root).collect()), key=str) == got


def test_two_merges_from_one_version_conflict(spark, tmp_path):
    root = str(tmp_path / "t")
    m = versions.create(current_rows(spark, 50), root, merge.KEY, "supermarket_id", buckets=2)
    versions._commit(spark, root, versions.replace(m, version=1))
    with pytest.raises(Exception, match="[Ee]xists"):
        versions._commit(spark, root, versions.replace(m, version=1))
    with pytest.raises(ValueError, match="other buckets"):
        versions.merge(current_rows(spark, 1), root, lambda held, new: held.withColumn("product_ean", F.concat("product_ean", F.lit("9"))))


def test_touched_buckets_are_the_only_ones_read(spark, tmp_path):
    root = str(tmp_path / "t")
    m = versions.create(current_rows(spark), root, merge.KEY, "supermarket_id", buckets=8)
    places = versions.touched(current_rows(spark, 1), m)
    files = versions.read(spark, root, m, places).inputFiles()
    assert len(places) == 1 and len(files) == 1
