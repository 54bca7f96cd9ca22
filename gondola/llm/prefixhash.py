"""Document fingerprints from prefix polynomial hashes.

Two modular prefix arrays (modulus 2**31 - 1, two bases) give the hash of any
span in constant time, so equal spans compare by two numbers and the longest
common prefix or suffix of two texts is a binary search. A fingerprint is the
hash and length of the whole text plus the smallest hashes of all its spans of
``SPAN`` bytes (a bottom-k sketch); the likeness of two fingerprints is the
share of common spans the sketches show.

The next document is found without collecting the order anywhere: documents are
range-partitioned by id, each sorted partition streams with one text held back,
and only the first and the last document of a partition meet in a second step.

Cases: null texts are empty; equal texts have equal fingerprints; two empty
texts have likeness 1, an empty and another text 0; rows that share an id follow
each other in order of text; a single row is its own next document; rows with a
null id come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mixed

P = np.uint64((1 << 31) - 1)
BASES = (982451653, 1566083941)
SPAN = 16
K = 32


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**62."""
    x = (x & P) + (x >> np.uint64(31))
    x = (x & P) + (x >> np.uint64(31))
    return np.where(x >= P, x - P, x)


_tables: list[np.ndarray] = [np.ones((2, 1), np.uint64), np.ones((2, 1), np.uint64)]


def base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(2, m >= n) powers of the bases and of their inverses."""
    if _tables[0].shape[1] < n:
        size = 1 << max(16, (n - 1).bit_length())
        for t in (0, 1):
            step = np.array([b if t == 0 else pow(b, -1, int(P)) for b in BASES], np.uint64)[:, None]
            table = np.ones((2, 1), np.uint64)
            while table.shape[1] < size:  # doubling: the second half is the first times base**half
                high = fold(table[:, -1:] * step)
                table = np.concatenate([table, fold(table * high)], 1)
            _tables[t] = table
    return _tables[0], _tables[1]


@dataclass
class Prefixes:
    """sums[b, i]: sum of (byte + 1) * base_b ** j over j < i, modulo P."""

    data: bytes
    sums: np.ndarray

    @classmethod
    def of(cls, data: bytes) -> "Prefixes":
        codes = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        sums = np.zeros((2, len(data) + 1), np.uint64)
        # running sums of terms below 2**31 stay far below 2**64
        np.cumsum(fold(codes[None] * base_powers(len(data))[0][:, : len(data)]), axis=1, out=sums[:, 1:])
        return cls(data, fold(sums))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hashes of byte spans, comparable between texts."""
        back = base_powers(len(self.data) + 1)[1][:, start]
        two = fold(fold(self.sums[:, end] + P - self.sums[:, start]) * back)
        return two[0] << np.uint64(31) | two[1]

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])

    def all_spans(self, width: int) -> np.ndarray:
        """31-bit hashes of all spans of a width (one base)."""
        n = len(self.data) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return fold(fold(self.sums[0, width:] + P - self.sums[0, :n]) * base_powers(n)[1][0, :n])


def common_prefix(a: Prefixes, b: Prefixes, at_a: int = 0, at_b: int = 0) -> int:
    """Longest common extension to the right of two positions, by binary search over span hashes."""
    low, high = 0, min(len(a.data) - at_a, len(b.data) - at_b)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(at_a, at_a + middle) == b.span(at_b, at_b + middle):
            low = middle
        else:
            high = middle - 1
    return low


@dataclass
class Print:
    whole: int
    size: int
    least: np.ndarray  # ascending, at most K

    def hex(self) -> str:
        return f"{self.whole:016x}{self.size:012x}" + "".join(f"{int(v) >> 33:08x}" for v in self.least)


def fingerprint(p: Prefixes) -> Print:
    n = len(p.data)
    hashes = p.all_spans(SPAN)
    if not len(hashes):
        return Print(p.span(0, n), n, mixed(np.array([p.span(0, n)], np.uint64)) if n else np.zeros(0, np.uint64))
    hashes = mixed(hashes)
    limit = np.uint64(min(float(1 << 64) - 4096, 4.0 * K / len(hashes) * 2.0 ** 64))  # about 4 K hashes are below
    least = np.unique(hashes[hashes <= limit])
    if len(least) < K:
        least = np.unique(hashes)
    return Print(p.span(0, n), n, least[:K])


def likeness(a: Print, b: Print) -> float:
    """Estimated share of common spans: of the K least hashes of both, those that both hold."""
    if (a.whole, a.size) == (b.whole, b.size):
        return 1.0
    both = np.union1d(a.least, b.least)[:K]
    if not len(both):
        return 0.0
    return float((np.isin(both, a.least) & np.isin(both, b.least)).mean())


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as many first code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, " \
         "near_next double, common_prefix bigint"
#: role 0: a finished row; 1, 2: the first or last document of a partition (3: both), which meet in the second step
PASSED = f"role int, slot bigint, text string, {RESULT}"


class Doc:
    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.prefixes = Prefixes.of(text.encode())
        self.print = fingerprint(self.prefixes)

    def row(self, after: "Doc") -> tuple:
        new = edited(self.text, after.text)
        data = new.encode()
        other = Prefixes.of(data)
        mark = fingerprint(other)
        return (self.doc_id, len(self.text), hashlib.sha256(data).hexdigest(), self.print.hex(), mark.hex(),
                likeness(self.print, mark), likeness(self.print, after.print), common_prefix(self.prefixes, other))


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"role": pa.int32(), "slot": pa.int64(), "text": pa.string(), "doc_id": pa.int64(), "n_chars": pa.int64(),
             "near_edited": pa.float64(), "near_next": pa.float64(), "common_prefix": pa.int64()}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns)], names=names)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one sorted partition; finished rows spread over slots, the ends go to slot -1."""
    names = ["role", "slot", "text", *COLUMNS]
    last: Doc | None = None
    end = lambda role, doc: (role, -1, doc.text, doc.doc_id, *[None] * 7)
    first: Doc | None = None
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            doc = Doc(doc_id, text)
            if last is None:
                first = doc
            else:
                out.append((0, (doc_id or 0) & 0xFFFF, None, *last.row(doc)))
            last = doc
        if out:
            yield _table(out, names)
    if first is last and first is not None:
        yield _table([end(3, first)], names)
    elif first is not None:
        yield _table([end(1, first), end(2, last)], names)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes finished rows; a last document meets the first one that follows it in the sorted slot -1."""
    opening: Doc | None = None
    waiting: Doc | None = None
    for batch in batches:
        roles = batch.column(0)
        out = []
        for i in np.flatnonzero(roles.to_numpy() > 0):
            role, doc = roles[i].as_py(), Doc(batch.column(3)[i].as_py(), batch.column(2)[i].as_py())
            if role & 1:
                opening = opening or doc
                if waiting is not None:
                    out.append(waiting.row(doc))
                    waiting = None
            if role & 2:
                waiting = doc
        done = batch.filter(pa.compute.equal(roles, 0)).select(COLUMNS)
        if done.num_rows:
            yield done
        if out:
            yield _table(out, COLUMNS)
    if waiting is not None:
        yield _table([waiting.row(opening)], COLUMNS)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    passed = ordered.mapInArrow(_stream, PASSED)
    met = passed.repartition("slot").sortWithinPartitions("slot", "doc_id", "text", "role")
    return met.mapInArrow(_finish, RESULT)


def report(docs: DataFrame) -> DataFrame:
    return fingerprints(docs.select("doc_id", "text"))
