"""Language identification by a byte convolutional network in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each window keeps every filter's maximum, and a softmax layer names its
language. A document's prediction averages the log probabilities of all its
windows, weighted by their length. The network is trained by backpropagation on
a bounded sample: at most ``per_class`` documents of each language, the first by
a hash of the id. All windows of all texts are scored; only the weights (fixed
size) travel.

Cases: null texts and texts without a letter are ``und`` with score 0; documents
without a language are predicted, not learned; with nothing to learn from, all
are ``und``.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored
from .text import as_bytes, slices

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 10  # of each width
DIM = 6
PAD = 256  # a byte value of its own, for the rest of a last window


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray  # (257, DIM)
    filters: list[np.ndarray]  # per width: (width * DIM, FILTERS)
    shift: np.ndarray  # of all filters
    out: np.ndarray  # (filters, langs)
    bias: np.ndarray


def windows_of(texts: list[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (n, length) of byte codes, the text of each, and its bytes. Empty texts have none."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // length)
    owner = np.repeat(np.arange(len(texts)), counts)
    flat = np.full(int(counts.sum()) * length, PAD, np.int16)
    starts = (np.cumsum(counts) - counts) * length
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(data))
    flat[at] = data
    part = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return flat.reshape(-1, length), owner, np.minimum(length, sizes[owner] - part * length)


def _conv(net: Net, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    x = net.embed[codes]  # (n, length, DIM)
    n, length, dim = x.shape
    tops, cols, where = [], [], []
    for width, weights in zip(WIDTHS, net.filters):
        spans = np.lib.stride_tricks.as_strided(x, (n, length - width + 1, width * dim), x.strides)
        y = spans.reshape(-1, width * dim) @ weights
        y = y.reshape(n, length - width + 1, -1)
        tops.append(y.max(1))
        cols.append(spans)
        where.append(y)
    return np.concatenate(tops, 1) + net.shift, cols, where


def log_probs(net: Net, codes: np.ndarray, step: int = 512) -> np.ndarray:
    parts = []
    for k in range(0, len(codes), step):
        top = np.maximum(_conv(net, codes[k:k + step])[0], 0)
        z = top @ net.out + net.bias
        z -= z.max(1, keepdims=True)
        parts.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
    return np.concatenate(parts) if parts else np.zeros((0, len(net.langs)), np.float32)


def chosen_windows(texts: list[bytes], per_text: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """At most ``per_text`` windows of each text, evenly spaced, and the text of each."""
    codes, owner, _ = windows_of(texts)
    if not len(codes):
        return codes, owner
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    keep = nth % np.maximum(1, -(-np.bincount(owner, minlength=len(texts)) // per_text))[owner] == 0
    return codes[keep], owner[keep]


def train(texts: list[bytes], langs: list[str], epochs: int = 6, **options) -> Net:
    codes, owner = chosen_windows(texts)
    return train_windows(codes, np.array(langs, object)[owner], sorted(set(langs)), epochs, **options)


def train_windows(codes: np.ndarray, langs: np.ndarray, names: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 0) -> Net:
    """Adam on the cross entropy of windows; each language weighs the same."""
    rng = np.random.default_rng(seed)
    make = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    n_filters = len(WIDTHS) * FILTERS
    net = Net(names, rng.normal(0, 0.5, (PAD + 1, DIM)).astype(np.float32), [make(w * DIM, FILTERS) for w in WIDTHS],
              np.zeros(n_filters, np.float32), make(n_filters, max(1, len(names))), np.zeros(max(1, len(names)), np.float32))
    if len(names) < 2 or not len(codes):
        return net
    number = {name: i for i, name in enumerate(names)}
    target = np.array([number[v] for v in langs])
    share = np.bincount(target, minlength=len(names))
    weight = (len(target) / (len(names) * share))[target].astype(np.float32)
    params = [net.embed, *net.filters, net.shift, net.out, net.bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for k in range(0, len(order), batch):
            t += 1
            at = order[k:k + batch]
            for p, g, m, v in zip(params, _gradients(net, codes[at], target[at], weight[at]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return net


def _gradients(net: Net, codes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    n = len(codes)
    raw, cols, where = _conv(net, codes)
    top = np.maximum(raw, 0)
    z = top @ net.out + net.bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(n), target] -= 1
    p *= weight[:, None] / n
    d_top = (p @ net.out.T) * (raw > 0)
    d_embed, d_filters = np.zeros_like(net.embed), []
    for i, width in enumerate(WIDTHS):
        part = d_top[:, i * FILTERS:(i + 1) * FILTERS]
        best = where[i].argmax(1)  # (n, FILTERS): only the maximum passes its gradient on
        chosen = cols[i][np.arange(n)[:, None], best]  # (n, FILTERS, width * DIM)
        d_filters.append(np.einsum("nf,nfd->df", part, chosen).astype(np.float32))
        back = part[:, :, None] * net.filters[i].T[None]  # (n, FILTERS, width * DIM)
        for j in range(width):
            np.add.at(d_embed, codes[np.arange(n)[:, None], best + j], back[:, :, j * DIM:(j + 1) * DIM])
    return [d_embed, *d_filters, d_top.sum(0), top.T @ p, p.sum(0)]


def predict(net: Net, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the likeliest language and its probability, per text."""
    best, score = np.zeros(len(texts), int), np.zeros(len(texts))
    for a, b in slices(texts):
        codes, owner, size = windows_of(texts[a:b])
        logs = log_probs(net, codes) * size[:, None]
        total = np.stack([np.bincount(owner, logs[:, j], b - a) for j in range(logs.shape[1])], 1)
        mean = total / np.maximum(1, [len(t) for t in texts[a:b]])[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        best[a:b] = p.argmax(1)
        score[a:b] = p.max(1) / p.sum(1)
    return best, score


def training_rows(docs: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, lang, codes): the training windows of at most ``per_class`` documents of each language, and no more of their texts."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
    picked = known.select("doc_id", "lang").distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_class).drop("_n")
    # written first: its size is then known, and only where it is small do the texts stay where they are
    picked = stored(picked, "picked")
    rows = known.select("doc_id", "lang", "text").join(picked, ["doc_id", "lang"])

    def run(batches):
        for batch in batches:
            codes, owner = chosen_windows(as_bytes(batch.column(2)))
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            held = [codes[i:j].tobytes() for i, j in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(held, pa.binary())], names=["doc_id", "lang", "codes"])

    return rows.mapInArrow(run, "doc_id bigint, lang string, codes binary")


def fit(docs: DataFrame, per_class: int = 300) -> Net:
    """Train in one task on at most ``per_class`` documents (ids) of each language, 12 windows of 128 bytes of a text;
    only the weights come to the driver. Of rows that share an id, the one with the least windows in byte order counts."""
    def run(batches):
        rows = sorted(row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
        codes = [np.frombuffer(c, np.int16).reshape(-1, WINDOW) for _, _, c in rows]
        langs = np.repeat(np.array([lang for _, lang, _ in rows], object), [len(c) for c in codes])
        net = train_windows(np.concatenate(codes) if codes else np.zeros((0, WINDOW), np.int16), langs, sorted({lang for _, lang, _ in rows}))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    sample = training_rows(docs.where(F.col("doc_id").isNotNull()), per_class).groupBy("doc_id", "lang").agg(F.min("codes").alias("codes"))
    one = sample.repartition(1).mapInArrow(run, "net binary").first()
    return pickle.loads(one.net) if one else train([], [])


def identify(docs: DataFrame, net: Net, text_col: str = "text") -> DataFrame:
    """``docs`` (its columns kept) with ``_lang`` and ``_lang_score``."""
    kept = [f for f in docs.schema.fields if f.name not in ("_lang", "_lang_score")]
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed number of weights
    text = F.col(text_col)
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    temp = "_has_letter"
    while temp in docs.columns:
        temp += "_"

    def run(batches):
        net = shared.value
        for batch in batches:
            texts = as_bytes(batch.column(text_col))
            best, score = predict(net, texts) if net.langs else (np.zeros(len(texts), int), np.zeros(len(texts)))
            told = batch.column(temp).to_numpy(zero_copy_only=False).astype(bool) & bool(net.langs)
            names = [net.langs[k] if ok else "und" for k, ok in zip(best, told)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], pa.array(names, pa.string()), pa.array(np.where(told, score, 0.0))],
                names=[*[f.name for f in kept], "_lang", "_lang_score"])

    return docs.withColumn(temp, lettered).mapInArrow(run, T.StructType([
        *kept, T.StructField("_lang", T.StringType()), T.StructField("_lang_score", T.DoubleType())]))


def report(docs: DataFrame) -> DataFrame:
    from .toxicity import held_out

    net = fit(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text", held_out().alias("held_out")), net)
    return found.select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_lang_score").alias("score"))
