"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence's score s is a logistic function of
hashed word and word-prefix features, and the document's is the noisy-or
1 - (1 - leak) prod(1 - p) of p = s * n ** (s - 1) over its n sentences: a sentence that
is sure counts whole in a text of any length, while unsure ones share one sentence's
weight, so length alone never makes a text toxic. Only document labels train it: the gradient of the document's
loss reaches each sentence through the noisy-or, so the sentences that explain
the label learn it, and the same scores locate them afterwards. Bias and leak are
learned with the weights, below bounds (MOST_BIAS, MOST_LEAK) that keep a text without
known features under 0.5: n sentences without any add about s * n ** s, s at most 0.007.

Features are those that stand in at least ``min_docs`` training documents; they
are looked up by their full 64-bit hash, so unknown words meet no weight.

Training is on a bounded sample: at most ``toxic`` and ``clean`` documents of either
label, the first by a hash of the id, found in the small label table before any text is
read. Scoring is one map over all documents with the sample's weights, which the
sample bounds; nothing is shuffled.

Cases: null and empty texts have no sentence and score the learned prior of an
empty document; documents without labels are scored like the rest; with no
labelled text every score is 0 (below 1e-9).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LETTER, Words, as_bytes, mixed, slices, span_hash, words_of

PREFIX = 5
FILTER_BITS = 20
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n"]] = True
MOST_BIAS, MOST_LEAK = -5.0, 0.25
PRIOR_RATE = 0.1


@dataclass
class Model:
    features: np.ndarray  # ascending hashes
    weights: np.ndarray  # one behind the last, 0, for unknown features
    bias: float
    leak: float  # probability that a document is toxic for no sentence's sake


@dataclass
class Bags:
    feature: np.ndarray
    sentence: np.ndarray  # of each feature, ascending
    bounds: np.ndarray  # sentences of document i
    start: np.ndarray  # byte span of each sentence in the joined lower-cased texts
    end: np.ndarray


def bags_of(texts: list[bytes]) -> Bags:
    words: Words = words_of(texts, LETTER)
    short = span_hash(words.prefix, words.start, np.minimum(words.end, words.start + PREFIX))
    ends = np.flatnonzero(ENDS[words.data])  # each text ends with a separator, so sentences never cross texts
    sentence = np.searchsorted(ends, words.start)
    used, sentence = np.unique(sentence, return_inverse=True)
    begin = np.concatenate([[0], ends[:-1] + 1])[used] if len(ends) else used
    doc_end = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.searchsorted(begin, np.concatenate([[0], doc_end]))
    feature = np.stack([words.hash, mixed(short + np.uint64(7))], 1).ravel()
    return Bags(feature, np.repeat(sentence, 2), bounds, begin, ends[used] if len(ends) else used)


def known(bags: Bags, features: np.ndarray) -> Bags:
    """Only the features of the model, as their numbers, each once a sentence."""
    some = np.zeros(1 << FILTER_BITS, bool)
    shift = np.uint64(64 - FILTER_BITS)
    some[features >> shift] = True
    maybe = np.flatnonzero(some[bags.feature >> shift])
    at = np.searchsorted(features, bags.feature[maybe])
    right = at < len(features)
    right[right] = features[at[right]] == bags.feature[maybe][right]
    pairs = np.unique(bags.sentence[maybe[right]] * (len(features) + 1) + at[right])
    return replace(bags, feature=pairs % (len(features) + 1), sentence=pairs // (len(features) + 1))


def _sentences(model: Model, bags: Bags) -> np.ndarray:
    n = int(bags.bounds[-1]) if len(bags.bounds) else 0
    z = np.bincount(bags.sentence, model.weights[bags.feature], n) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _counted(s: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What sentences of score ``s`` count in the noisy-or, and the log of their document's number of sentences."""
    sizes = np.diff(bounds)
    log_n = np.repeat(np.log(np.maximum(sizes, 1)), sizes)
    return np.minimum(s * np.exp((s - 1) * log_n), 1 - 1e-12), log_n


def _by_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def score_texts(model: Model, texts: list[bytes]) -> tuple[np.ndarray, list[bytes | None], np.ndarray]:
    """Document scores, each one's most toxic sentence, and that sentence's score."""
    scores, worst, tops = np.zeros(len(texts)), [None] * len(texts), np.zeros(len(texts))
    for a, b in slices(texts):
        bags = known(bags_of(texts[a:b]), model.features)
        p = _sentences(model, bags)
        calm = np.log1p(-_counted(p, bags.bounds)[0])
        scores[a:b] = 1 - (1 - model.leak) * np.exp(_by_doc(calm, bags.bounds))
        joined = b"\n".join(texts[a:b])
        for i in np.flatnonzero(scores[a:b] >= 0.5):
            lo, hi = bags.bounds[i], bags.bounds[i + 1]
            if lo < hi:
                k = lo + int(np.argmax(p[lo:hi]))
                worst[a + i], tops[a + i] = joined[bags.start[k]: bags.end[k]].strip(), p[k]
    return scores, worst, tops


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.3,
          sparsity: float = 3e-4, min_docs: int = 8, seed: int = 0) -> Model:
    """Adagrad on the noisy-or log loss of documents for weights, bias and leak; the L1 step keeps weights of uninformative words at 0."""
    if not len(labels):
        return Model(np.zeros(0, np.uint64), np.zeros(1), -30.0, 0.0)
    order, rng = np.arange(len(labels)), np.random.default_rng(seed)
    rng.shuffle(order)
    groups = [order[k:k + batch] for k in range(0, len(order), batch)]
    of = lambda g: bags_of([texts[i] for i in g])  # noqa: E731  made twice, as all at once would take much memory
    features = _frequent(map(of, groups), min_docs)
    parts = [(known(of(g), features), labels[g].astype(float)) for g in groups]
    model = Model(features, np.zeros(len(features) + 1), -9.0, 1e-3)
    square = np.full(len(features) + 1, 1e-3)
    prior = np.array([model.bias, np.log(model.leak / (1 - model.leak))])  # bias, and leak on the logistic scale
    most, prior_square = np.array([MOST_BIAS, np.log(MOST_LEAK / (1 - MOST_LEAK))]), np.full(2, 1e-3)
    for _ in range(epochs):
        for k in rng.permutation(len(parts)):
            bag, y = parts[k]
            s = _sentences(model, bag)
            p, log_n = _counted(s, bag.bounds)
            calm = _by_doc(np.log1p(-p), bag.bounds) + np.log(1 - model.leak)
            doc = np.clip(1 - np.exp(calm), 1e-6, 1 - 1e-9)
            # d loss / d log(1 - p) is (y - doc) / doc for each sentence of the document; d log(1 - p) / dz is
            # -p / (1 - p) * (1 - s) * (1 + s log n), and -s where n is 1
            share = (doc - y) / doc / len(y)
            pull = np.repeat(share, np.diff(bag.bounds)) * p / (1 - p) * (1 - s) * (1 + s * log_n)
            grad = np.bincount(bag.feature, pull[bag.sentence], len(features) + 1)
            square += grad ** 2
            pace = rate / np.sqrt(square)
            moved = model.weights - pace * grad
            model.weights = np.sign(moved) * np.maximum(np.abs(moved) - pace * sparsity, 0)
            slope = np.array([pull.sum(), share.sum() * model.leak])
            prior_square += slope ** 2
            prior = np.clip(prior - PRIOR_RATE * slope / np.sqrt(prior_square), -15, most)
            model.bias, model.leak = float(prior[0]), float(1 / (1 + np.exp(-prior[1])))
    used = np.flatnonzero(model.weights[:-1])
    return Model(features[used], np.append(model.weights[used], 0), model.bias, model.leak)


def _frequent(bags: Iterable[Bags], min_docs: int) -> np.ndarray:
    """Features that stand in at least ``min_docs`` documents."""
    pairs = []
    for b in bags:
        doc = np.searchsorted(b.bounds, b.sentence, "right").astype(np.uint64)
        pairs.append(b.feature[np.unique(mixed(b.feature ^ mixed(doc)), return_index=True)[1]])
    value, count = np.unique(np.concatenate(pairs), return_counts=True)
    return value[count >= min_docs]


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> DataFrame:
    """(text, toxic): at most so many documents of each label, the first by a hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.col("doc_id").cast("string")), "doc_id"]
    picked = known.where("toxic = 0").orderBy(*order).limit(clean).unionAll(
        known.where("toxic = 1").orderBy(*order).limit(toxic))
    # at most toxic + clean ids: a proven bound
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, toxic: int = 1500, clean: int = 6000) -> Model:
    """Train in one task on the bounded sample; only the model comes to the driver."""
    def run(batches):
        rows = sorted((i, t, y) for b in batches for i, t, y in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist()))
        model = train([t for _, t, _ in rows], np.array([y for _, _, y in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.features.tobytes()]), pa.array([model.weights.tobytes()]), pa.array([model.bias]),
                                          pa.array([model.leak])], names=["features", "weights", "bias", "leak"])

    sample = labelled_sample(docs, labels, toxic, clean).select("doc_id", "text", F.col("toxic").cast("long").alias("toxic"))
    one = sample.repartition(1).mapInArrow(run, "features binary, weights binary, bias double, leak double").first()
    if one is None:  # no partition at all
        return train([], np.zeros(0, np.int64))
    return Model(np.frombuffer(one.features, np.uint64), np.frombuffer(one.weights), one.bias, one.leak)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` (its columns kept) with ``_score``, ``_worst`` sentence of rejected documents and its ``_worst_score``."""
    kept = [f for f in docs.schema.fields if f.name not in ("_score", "_worst", "_worst_score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column(text_col))
            scores, worst, tops = score_texts(shared.value, texts)
            said = pa.array([None if w is None else w.decode("utf-8", "replace") for w in worst], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(scores), said, pa.array(tops)],
                                             names=[*[f.name for f in kept], "_score", "_worst", "_worst_score"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("_score", T.DoubleType()), T.StructField("_worst", T.StringType()),
                                              T.StructField("_worst_score", T.DoubleType())]))


def held_out(id_col: str = "doc_id", folds: int = 5):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs.where(~held_out()), labels.where(~held_out()))
    scored = score(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return scored.select("doc_id", "held_out", F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"),
                         F.col("_worst").alias("worst_sentence"))
