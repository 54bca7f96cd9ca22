"""Structured Streaming jobs: price changes, alert suppression, daily trend.

Every job takes a streaming DataFrame and a base folder on storage that all
executors share; checkpoints and state live there, so a lost executor or a
restart continues from the last committed batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.monitor import failure_streaks

# Fixed values.
ALERT_COOLDOWN_SECONDS = 3600
FAILURE_COOLDOWN_SECONDS = 1800
FAILURES_BEFORE_ALERT = 2


# -- price changes -----------------------------------------------------------------
#: Newest row of each key of a block, keys ascending.
LAST_PRICES = "keys binary, at binary, ids array<string>, pairs array<string>"


def _ordered(batch: pd.DataFrame) -> pd.DataFrame:
    """Rows by (key, at, id); texts are only compared where key and time are equal."""
    key, at = batch["key"].to_numpy(), batch["at"].to_numpy()
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    tied = np.zeros(len(order) + 1, bool)
    tied[1:-1] = (key[1:] == key[:-1]) & (at[1:] == at[:-1])
    tied = tied[1:] | tied[:-1]
    if tied.any():
        rank = np.zeros(len(order), np.int64)
        rank[tied] = np.unique(batch["id"].to_numpy()[order[tied]], return_inverse=True)[1]
        order = order[np.lexsort((rank, at, key))]
    return batch.take(order)


def last_prices(block: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes among a batch's rows of a block of keys; the state is the newest value of each of its keys.

    Rows of a key count in the order of (at, id), inside a batch and across batches. A row that is not newer
    than the stored one is late: it is neither a change nor does it replace the stored value.
    """
    batch = _ordered(pd.concat(parts, ignore_index=True))
    of, at, id_, pair = (batch[c].to_numpy() for c in ("key", "at", "id", "pair"))
    seen, before = np.zeros(len(of), bool), np.full(len(of), "", object)
    if state.exists:
        keys, last_at = (np.frombuffer(v, np.int64) for v in state.get[:2])
        last_id, last_pair = (np.array(v, object) for v in state.get[2:])
        place = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
        seen = keys[place] == of
        newer = ~seen | (at > last_at[place])
        same = np.flatnonzero(seen & (at == last_at[place]))
        newer[same] = id_[same] > last_id[place[same]]
        of, at, id_, pair, seen, before = (v[newer] for v in (of, at, id_, pair, seen, last_pair[place]))
    first = np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    changed = first & ~seen
    before[~first] = pair[:-1][~first[1:]]
    changed |= before != pair
    final = np.flatnonzero(np.roll(first, -1))
    if len(final):
        new = [v[final] for v in (of, at, id_, pair)]
        if state.exists:
            kept = ~np.isin(keys, new[0])
            new = [np.concatenate([v[kept], n]) for v, n in zip((keys, last_at, last_id, last_pair), new)]
            order = np.argsort(new[0])
            new = [v[order] for v in new]
        state.update((new[0].tobytes(), new[1].tobytes(), new[2].tolist(), new[3].tolist()))
    yield pd.DataFrame({"id": id_[changed], "key": of[changed], "at": at[changed], "pair": pair[changed]})


def price_changes(observations: DataFrame, block: int = 256) -> DataFrame:
    """Rows of a stream whose (price, list_price) differs from the preceding value of their key; the first row of a
    key counts as changed. observations: id, key (a number), scraped_at, price, list_price.

    ``block`` neighbouring keys share a state row, which travels with their rows: a batch reads and writes the blocks of
    its own keys, and no block grows with the table. Keys are serial numbers; far apart, each makes a block of its own.
    """
    kinds = {c: observations.schema[c].dataType for c in ("price", "list_price")}
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = observations.select(
        F.expr(f"cast(key AS bigint) div {int(block)}").alias("block"), F.col("id").cast("string").alias("id"), F.col("key").cast("bigint").alias("key"),
        F.unix_micros("scraped_at").alias("at"), F.concat(text("price"), F.lit("|"), text("list_price")).alias("pair"))
    out = rows.groupBy("block").applyInPandasWithState(
        last_prices, "id string, key bigint, at bigint, pair string", LAST_PRICES, "append", GroupStateTimeout.NoTimeout)
    value = lambda c, i: F.nullif(F.split_part("pair", F.lit("|"), F.lit(i)), F.lit("")).cast(kinds[c]).alias(c)
    return out.select("id", "key", F.timestamp_micros("at").alias("scraped_at"), value("price", 1), value("list_price", 2))


# -- alert suppression -------------------------------------------------------------
# Cool-downs count whole seconds, so of all alerts of a key in one second only the
# first can be sent. Reducing to one row per (key, second) first bounds what one
# key brings to a task by the time span, however many alerts it has.
def _send(seconds: np.ndarray, last: int | None, cooldown: int) -> tuple[list[int], int | None]:
    """Positions sent out of the sorted seconds, and the second of the last one."""
    sent, at = [], 0 if last is None else int(np.searchsorted(seconds, last + cooldown))
    while at < len(seconds):
        sent.append(at)
        last = int(seconds[at])
        at = int(np.searchsorted(seconds, last + cooldown))
    return sent, last


class MuteRepeats(StatefulProcessor):
    """Lets an alert of a key pass and mutes later ones until the cool-down is over."""

    def __init__(self, cooldown_seconds: int):
        self.cooldown = cooldown_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_sent", "second bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.last.get()
        seconds = np.sort(np.concatenate([part["second"].to_numpy() for part in rows]))
        sent, last = _send(seconds, None if stored is None else stored[0], self.cooldown)
        if sent:
            self.last.update((last,))
        yield pd.DataFrame({"alert": key[0], "second": seconds[sent]})

    def close(self) -> None:
        pass


def suppress_repeats(alerts: DataFrame, cooldown_seconds: int = ALERT_COOLDOWN_SECONDS, delay: str = "1 hour") -> DataFrame:
    """alerts: alert, at. Gives (alert, second) of the alerts that are sent."""
    per_second = (
        alerts.withWatermark("at", delay).withColumn("second", F.unix_seconds("at"))
        .dropDuplicatesWithinWatermark(["alert", "second"]).select("alert", "second"))
    return per_second.groupBy("alert").transformWithStateInPandas(
        statefulProcessor=MuteRepeats(cooldown_seconds), outputStructType="alert string, second bigint",
        outputMode="append", timeMode="none")


# Failure alerts: an alert at second s lets the next one pass from s + cooldown on. A chunk of that length
# holds at most one sent alert, so a chunk is a jump function from the earliest second allowed to the earliest
# allowed behind it. The functions of the chunks of a block (up to 48 chunks of one source) are composed in one row, the
# composed ones take a source's state from block to block, and every block then finds its alerts on its own.
CHUNKS_IN_BLOCK = 48
_FREE = -(1 << 62)


def _first_from(seconds: Column, allowed: Column) -> Column:
    return F.get(F.filter(seconds, lambda s: s >= allowed), F.lit(0))


def _jump(chunk: Column, allowed: Column, cooldown: int) -> Column:
    """Earliest second allowed behind the chunk: after the alert it sends, or unchanged if it sends none."""
    return F.coalesce(_first_from(chunk["seconds"], allowed) + cooldown, allowed)


def _given(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def composed_jump(chunks: Column, cooldown: int) -> Column:
    """The jump over all chunks of a block as steps (upto, allowed): entries up to ``upto`` leave as ``allowed``.

    What is allowed at the start of a block lies less than a cool-down behind it, so the steps can only lie at
    the first chunk's seconds; steps that meet are merged, which soon leaves a few.
    """
    whole = lambda a: F.lit(a).cast("bigint")
    first = F.get(chunks, F.lit(0))["seconds"]
    steps = F.concat(
        F.transform(first, lambda s: F.struct(s.alias("upto"), (s + cooldown).alias("allowed"))),
        F.array(F.struct(whole(1 << 62).alias("upto"), whole(_FREE).alias("allowed"))))

    def over(found: Column, chunk: Column) -> Column:
        moved = F.transform(found, lambda p: F.struct(p["upto"].alias("upto"), _jump(chunk, p["allowed"], cooldown).alias("allowed")))
        # of steps with one value the last, which reaches furthest
        return _given(moved, lambda m: F.filter(m, lambda p, i: F.coalesce(F.get(m, i + 1)["allowed"] != p["allowed"], F.lit(True))))

    return F.aggregate(F.slice(chunks, 2, CHUNKS_IN_BLOCK), steps, over)


def cooled_down(per_second: DataFrame, cooldown: int, last: DataFrame | None = None) -> DataFrame:
    """(source_slug, second) of the alerts that pass; per_second: source_slug, second, one row each.

    ``last`` has the second of the last alert (source_slug, last_second) sent before.
    """
    rows = per_second.select("source_slug", "second")
    if last is not None:
        rows = rows.join(last.select("source_slug", "last_second"), "source_slug", "left").where(
            F.col("last_second").isNull() | (F.col("second") >= F.col("last_second") + cooldown)).drop("last_second")
    chunk = F.floor(F.col("second") / cooldown)
    chunks = rows.groupBy("source_slug", chunk.alias("chunk")).agg(F.sort_array(F.collect_list("second")).alias("seconds"))
    blocks = chunks.groupBy("source_slug", F.floor(F.col("chunk") / CHUNKS_IN_BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("chunk", "seconds"))).alias("chunks"))
    jumps = blocks.select("source_slug", F.struct("block", composed_jump(F.col("chunks"), cooldown).alias("steps")).alias("b"))

    def through(state: Column, block: Column) -> Column:
        step = F.get(F.filter(block["steps"], lambda p: p["upto"] >= state["allowed"]), F.lit(0))
        return F.struct(
            # nothing allowed before the last block holds back the next: a block is longer than the cool-down
            F.greatest(step["allowed"], state["allowed"]).alias("allowed"),
            F.concat(state["entries"], F.array(F.struct(block["block"].alias("block"), state["allowed"].alias("entry")))).alias("entries"))

    start = F.struct(F.lit(_FREE).cast("bigint").alias("allowed"), F.array().cast("array<struct<block:bigint,entry:bigint>>").alias("entries"))
    # one row per source with a step list for each of its blocks (a day at the usual cool-down)
    entries = jumps.groupBy("source_slug").agg(F.array_sort(F.collect_list("b")).alias("blocks")).select(
        "source_slug", F.explode(F.aggregate("blocks", start, through)["entries"]).alias("e")).select("source_slug", "e.block", "e.entry")

    def send(state: Column, chunk: Column) -> Column:
        sent = _first_from(chunk["seconds"], state["allowed"])
        return F.struct(F.coalesce(sent + cooldown, state["allowed"]).alias("allowed"),
                        F.concat(state["sent"], F.filter(F.array(sent), lambda s: s.isNotNull())).alias("sent"))

    begin = F.struct(F.col("entry").alias("allowed"), F.array().cast("array<bigint>").alias("sent"))
    return blocks.join(entries, ["source_slug", "block"]).select(
        "source_slug", F.explode(F.aggregate("chunks", begin, send)["sent"]).alias("second"))


def failure_alerts_of_batch(log: DataFrame, state: DataFrame | None, threshold: int = FAILURES_BEFORE_ALERT,
                            cooldown_seconds: int = FAILURE_COOLDOWN_SECONDS) -> DataFrame:
    """Alerts and the new state in one result, told apart by ``kind``, for a batch of id, source_slug, checked_at,
    is_healthy.

    kind alert: id, source_slug, checked_at, failures. kind state: source_slug, failures (counted at the end),
    last_second (of the last alert sent). Streaks come from the chunked running count, the cool-down from jump functions.
    """
    initial = None if state is None else state.select("source_slug", F.col("failures").alias("initial"))
    streaks = failure_streaks(log, initial)
    second = F.unix_seconds("checked_at")
    per_second = streaks.filter(F.col("failures") >= threshold).groupBy("source_slug", second.alias("second")).agg(
        F.min(F.struct("checked_at", "id", "failures")).alias("a"))
    alerts = per_second.join(cooled_down(per_second, cooldown_seconds, state), ["source_slug", "second"])
    ends = streaks.groupBy("source_slug").agg(F.max_by("failures", F.struct("checked_at", "id")).alias("failures"))
    marks = ends.select("source_slug", "failures", F.lit(None).cast("bigint").alias("last_second"), F.lit(1).alias("_order")).unionByName(
        alerts.groupBy("source_slug").agg(F.max("second").alias("last_second")).select(
            "source_slug", F.lit(None).cast("bigint").alias("failures"), "last_second", F.lit(1).alias("_order")))
    if state is not None:
        marks = marks.unionByName(state.select("source_slug", "failures", "last_second", F.lit(0).alias("_order")))
    newest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c)
    new = marks.groupBy("source_slug").agg(newest("failures"), newest("last_second"))
    none = lambda kind: F.lit(None).cast(kind)
    return alerts.select(F.lit("alert").alias("kind"), "a.id", "source_slug", "a.checked_at", "a.failures", none("bigint").alias("last_second")).unionByName(
        new.select(F.lit("state").alias("kind"), none("bigint").alias("id"), "source_slug", none("timestamp").alias("checked_at"), "failures", "last_second"))


ALERT_ROWS = "id bigint, source_slug string, checked_at timestamp, failures bigint, last_second bigint"


def stream_failure_alerts(health: DataFrame, base: str) -> StreamingQuery:
    """One write per batch, ``base/batch=<n>``, with the alerts in ``kind=alert`` and the small per-source state in
    ``kind=state``; repeating a batch overwrites the same folder."""
    def write(batch: DataFrame, number: int) -> None:
        state = batch.sparkSession.read.schema(ALERT_ROWS).parquet(f"{base}/batch={number - 1}/kind=state") if number > 0 else None
        failure_alerts_of_batch(batch, state).write.mode("overwrite").partitionBy("kind").parquet(f"{base}/batch={number}")

    return (health.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True).start())


# -- daily trend ---------------------------------------------------------------------
def daily_distinct_products(staged: DataFrame, delay: str = "2 days") -> DataFrame:
    """Distinct EANs per finished day; staged: ean, created_at. Late rows beyond the delay are expired."""
    unique = (
        staged.withWatermark("created_at", delay).withColumn("day", F.to_date("created_at"))
        .dropDuplicatesWithinWatermark(["ean", "day"]))
    return unique.groupBy(F.window("created_at", "1 day").alias("w")).agg(F.count("*").alias("detected")).select(
        F.col("w.start").alias("day"), "detected")


def run_to_parquet(stream: DataFrame, base: str) -> StreamingQuery:
    """Process everything available into ``base/out``."""
    return (stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
            .outputMode("append").trigger(availableNow=True).start())
