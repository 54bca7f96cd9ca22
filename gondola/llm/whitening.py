"""Embedding whitening by polarisation: covariances out of variances alone.

Entries become whole numbers, so every sum is exact in any order. One pass over
the distinct vectors gives count and sums; a second, centred at the whole part
of the mean, gives the squared deviations of every dimension and of the sum of
every two dimensions. Since var(i + j) = var(i) + var(j) + 2 cov(i, j), the
cross covariances are differences of these; the fraction cut from the mean is
put back in whole numbers. The matrix is then small: ``eigh`` on the driver
gives the components, and a map over all rows projects them. A third pass over
the distinct vectors measures how far their whitened covariance is from the
identity.

The driver holds dimensions squared, whatever the number of rows; tasks hold one
Arrow batch. Batches whose squares might pass 64 bits are summed with Python's
integers.

Cases: rows whose vector is null or has null or non-finite entries are dropped,
and so are vectors of another length than the most frequent one (the longer, if
two are equally frequent), empty ones included; repeated vectors count once in the fit but every row is
returned, also with a null or repeated id; entries beyond 2**56 are held there;
a component without variance has a null ``whitened``; no usable row gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

SCALE, OFFSET = 64, 1_000_000
MOST = 16
BOUND = float(1 << 62)
#: Exact partial sums travel as value = high * 2**64 + low.
LIMBS = "place int, high decimal(38,0), low decimal(38,0)"
_LOW = (1 << 64) - 1


@dataclass
class Model:
    count: int
    sums: list[int]  # per dimension, over the distinct vectors
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column per component
    trace: float
    identity_error: float | None = None

    def __post_init__(self):
        self.center = np.array([s // self.count for s in self.sums], np.int64)
        self.rest = [s - self.count * int(c) for s, c in zip(self.sums, self.center)]

    def whitened(self, x: np.ndarray, most: int) -> np.ndarray:
        """Rows projected on the components, over the root of the eigenvalue; NaN where that is no variance."""
        centred = (x - self.center).astype(np.float64) - np.array(self.rest, np.float64) / self.count
        sure = self.values[:most] > len(self.sums) * np.finfo(float).eps * max(float(self.values[0]), 0.0)
        root = np.where(sure, np.sqrt(np.where(sure, self.values[:most], 1.0)), np.nan)
        return centred @ self.vectors[:, :most] / root

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2 of each row."""
        d, n = x - self.center, self.count
        wide = _wide(d, max(self.rest, default=0) + 1)
        d = d.astype(object) if wide else d
        rest = np.array(self.rest, object if wide else np.int64)
        square, cross = (d * d).sum(axis=1).tolist(), (d * rest).sum(axis=1).tolist()
        fixed = sum(r * r for r in self.rest)
        return [n * n * a - 2 * n * b + fixed for a, b in zip(square, cross)]


def _wide(d: np.ndarray, factor: int = 1) -> bool:
    """Whether sums of products over the batch may leave 64 bits."""
    if not d.size:
        return False
    most = max(abs(int(d.max())), abs(int(d.min())), 1)
    return 4 * max(most, factor) * most * max(d.shape) >= 1 << 62


def whole_vectors(vectors: DataFrame, vector_col: str, *keep: Column) -> DataFrame:
    """The kept columns and ``x``, the vector in whole numbers, of the rows that have one."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(c.cast("double"), F.lit(0.0))))
    held = lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(
        c.cast("double") * SCALE, F.lit(-BOUND)), F.lit(BOUND))), F.lit(-(1 << 62))), F.lit(1 << 62))
    return vectors.where(v.isNotNull() & finite).select(*keep, F.transform(v, lambda c: held(c) + OFFSET).alias("x"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _limbs(totals: list[int]) -> pa.RecordBatch:
    kind = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays([
        pa.array(range(len(totals)), pa.int32()), pa.array([Decimal(t >> 64) for t in totals], kind),
        pa.array([Decimal(t & _LOW) for t in totals], kind)], names=["place", "high", "low"])


def exact_totals(fit: DataFrame, measure) -> list[int]:
    """Sums over all rows of what ``measure`` gives for a batch (a list of Python integers of one length)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = measure(matrix(batch.column("x")))
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            yield _limbs(total)

    rows = fit.select("x").mapInArrow(run, LIMBS).groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return [(int(r.high) << 64) + int(r.low) for r in sorted(rows, key=lambda r: r.place)]


def counted_sums(x: np.ndarray) -> list[int]:
    """Number of rows, then the sum of each dimension."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [len(x), *[(int(a) << 32) + int(b) for a, b in zip(high, low)]]


def squared(center: np.ndarray):
    """Squared deviations from ``center``: of each dimension, then of each sum of two dimensions."""
    def measure(x: np.ndarray) -> list[int]:
        d = x - center
        d = d.astype(object) if _wide(2 * d.astype(object) if _wide(d) else 2 * d) else d
        out = (d * d).sum(axis=0).tolist()
        for i in range(d.shape[1] - 1):
            pair = d[:, i:i + 1] + d[:, i + 1:]
            out += (pair * pair).sum(axis=0).tolist()
        return [int(v) for v in out]

    return measure


def covariance(count: int, rest: list[int], totals: list[int]) -> list[list[int]]:
    """count**2 times the covariances, in whole numbers.

    With squares about the whole part of the mean, (Q(i+j) - Q(i) - Q(j)) / 2 is the sum of
    products; ``rest``, the sums about it, centre them at the mean itself.
    """
    dims = len(rest)
    out = [[0] * dims for _ in range(dims)]
    place = dims
    for i in range(dims):
        out[i][i] = count * totals[i] - rest[i] * rest[i]
        for j in range(i + 1, dims):
            product = (totals[place] - totals[i] - totals[j]) // 2
            out[i][j] = out[j][i] = count * product - rest[i] * rest[j]
            place += 1
    return out


def distinct_vectors(vectors: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """The distinct whole vectors of the most frequent length, in a table of their own, and that length."""
    whole = whole_vectors(vectors, vector_col)
    length = whole.groupBy(F.size("x").alias("length")).count().where("length > 0").orderBy(F.desc("count"), F.desc("length")).first()
    dims = length["length"] if length else 0
    return stored(whole.where(F.size("x") == dims).distinct(), "vectors"), dims


def fit(vectors: DataFrame, vector_col: str = "embedding", most: int = MOST) -> Model | None:
    """Count, sums and components of the distinct vectors; None where no row has a usable vector."""
    distinct, dims = distinct_vectors(vectors, vector_col)
    if not dims:
        return None
    count, *sums = exact_totals(distinct, counted_sums)
    center = np.array([s // count for s in sums], np.int64)
    rest = [s - count * int(c) for s, c in zip(sums, center)]
    exact = covariance(count, rest, exact_totals(distinct, squared(center)))
    v = np.array([[a / (count * count) for a in row] for row in exact])
    values, columns = np.linalg.eigh(v)
    values, columns = values[::-1], columns[:, ::-1]
    columns = columns * np.sign(columns[np.abs(columns).argmax(axis=0), np.arange(dims)])
    model = Model(count, sums, values, columns, sum(exact[i][i] for i in range(dims)) / (count * count))
    model.identity_error = identity_error(distinct, model, most)
    return model


def identity_error(distinct: DataFrame, model: Model, most: int) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, measured on the vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                z = model.whitened(matrix(batch.column("x")), most)
                total = total + np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["place", "value"])

    rows = distinct.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.array([r.value for r in sorted(rows, key=lambda r: r.place)])
    k = min(most, len(model.values))
    mean = total[:k] / model.count
    off = total[k:].reshape(k, k) / model.count - np.outer(mean, mean) - np.eye(k)
    return float(np.nanmax(np.abs(off))) if np.isfinite(off).any() else 0.0


WHITE = "n bigint, deviation bigint, deviation_digits string, component int, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, model: Model | None, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST) -> DataFrame:
    """A row for each usable vector and component: id, n, deviation (null beyond 64 bits; ``deviation_digits`` has it
    whole), component from 1, whitened, explained, identity_error."""
    id_kind = vectors.select(F.col(id_col)).schema[0].dataType.simpleString()
    dims = len(model.sums) if model else 0
    rows = whole_vectors(vectors, vector_col, F.col(id_col).alias("id")).where(F.size("x") == (dims or -1))
    names = [f.split()[0] for f in WHITE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = min(most, dims)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix(batch.column("x"))
            z, exact = model.whitened(x, most).ravel(), model.deviation(x)
            each = np.repeat(np.arange(m), k)
            values = {
                "n": np.full(m * k, model.count), "deviation": pa.array([e if e < 1 << 63 else None for e in exact], pa.int64()).take(pa.array(each)),
                "deviation_digits": pa.array([str(e) for e in exact]).take(pa.array(each)), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                "whitened": pa.array(z, from_pandas=True), "explained": np.tile(model.values[:k] / model.trace if model.trace else np.zeros(k), m),
                "identity_error": np.full(m * k, model.identity_error)}
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(each)), *[pa.array(values[n]) for n in names]], names=["id", *names])

    return rows.mapInArrow(run, f"id {id_kind}, {WHITE}").withColumnRenamed("id", id_col)


def report(embeddings: DataFrame) -> DataFrame:
    model = fit(embeddings)
    return whiten(embeddings, model).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits")
