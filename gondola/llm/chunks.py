"""Questions that chunks of documents put to buckets of a hash space, round by round.

Documents are dealt to chunks of a bounded number of bytes by a hash. In each
round every chunk reduces what it wants to know to sorted arrays, one row per
bucket of the hash space; a bucket sees the questions of all chunks about its
keys and answers each. Whatever a chunk holds many times it asks once, so a key
that stands in a third of all documents is one entry per chunk. All rounds read
the same exchange of the texts; answers that later rounds need pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ``key`` is what the next exchange deals by: a bucket, or -1 - chunk for a row that only passes through
ROWS = "key bigint, bucket bigint, chunk bigint, round int, data binary, more binary, last binary"
NAMES = ["key", "bucket", "chunk", "round", "data", "more", "last"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


@dataclass
class Row:
    """Up to three arrays about the keys of a bucket, from or to a chunk."""

    bucket: int
    chunk: int
    data: bytes = b""
    more: bytes = b""
    last: bytes = b""


def total_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def dealt(docs: DataFrame, id_col: str, text_col: str, chunks: int) -> DataFrame:
    """(chunk, id, text), partitioned by chunk."""
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(chunks)).alias("chunk"),
                       F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.repartition(chunks, "chunk")


def _table(rows: Iterable[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(NAMES)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], names=NAMES)


def split(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of the non-empty runs of ascending keys, whose upper 32 bits are the bucket."""
    ends = np.searchsorted(keys, np.arange(1, buckets + 1, dtype=np.uint64) << np.uint64(32))
    starts = np.concatenate([[0], ends[:-1]])
    return [(int(b), int(starts[b]), int(ends[b])) for b in np.flatnonzero(ends > starts)]


def ask(chunked: DataFrame, answers: DataFrame | None, number: int,
        work: Callable[[pa.Table, dict[int, list[Row]]], Iterable[Row]]) -> DataFrame:
    """Questions of round ``number``; ``work`` gets a chunk and the answers so far, by round and in bucket order."""
    made = lambda rows: [(r.bucket, r.bucket, r.chunk, number, r.data, r.more, r.last) for r in rows]
    if answers is None:
        return chunked.groupBy("chunk").applyInArrow(lambda left: _table(made(work(left, {}))), ROWS)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([])
        told = told_of(right)
        passed = [(-1 - r.chunk, r.bucket, r.chunk, n, r.data, r.more, r.last) for n, rows in told.items() for r in rows]
        return _table([*passed, *made(work(left, told))])

    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, ROWS)


def answer(asked: DataFrame, work: Callable[[list[Row]], Iterable[Row]]) -> DataFrame:
    """One answer row per question row; ``work`` gets all rows of a bucket, in chunk order."""
    def run(table: pa.Table) -> pa.Table:
        if table["key"][0].as_py() < 0:
            return table
        (number, rows), = told_of(table).items()
        return _table([(r.bucket, r.bucket, r.chunk, number, r.data, r.more, r.last) for r in work(rows)])

    return asked.groupBy("key").applyInArrow(run, ROWS)


def told_of(table: pa.Table) -> dict[int, list[Row]]:
    found: dict[int, list[Row]] = {}
    for number, *rest in zip(*[table[n].to_pylist() for n in ("round", *NAMES[1:3], *NAMES[4:])]):
        found.setdefault(number, []).append(Row(*rest))
    return {n: sorted(rows, key=lambda r: (r.bucket, r.chunk)) for n, rows in found.items()}


def conclude(chunked: DataFrame, answers: DataFrame, work: Callable[[pa.Table, dict[int, list[Row]]], pa.Table], schema: str) -> DataFrame:
    """The result of each chunk, given all answers."""
    names = [c.split()[0] for c in schema.split(", ")]
    empty = chunked.sparkSession.createDataFrame([], schema).toArrow().schema
    run = lambda left, right: work(left, told_of(right)).select(names).cast(empty) if left.num_rows else empty.empty_table()
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def joined(rows: list[Row], field: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(getattr(r, field) for r in rows), kind)
