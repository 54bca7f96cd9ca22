"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` long, learned from the
training documents, with A-Z lower-cased and an end symbol behind each text. A
symbol is coded in the longest known context: seen c times among n, it has
probability (2c - 1) / 2n, and the d distinct symbols leave d / 2n to the escape
(method D). An escape leads to the next shorter context, where the symbols the longer context has seen are excluded; below
the empty context all symbols left are equally likely. Probabilities of all
symbols add up to one in every context.

The trie is a family of tables, one per order, aggregated from the distinct
(context, symbol) keys of the corpus; each order's code lengths join the one
below. Chunks of documents ask for their distinct keys and tokens only, so what
is shuffled grows with distinct keys per chunk and no key is hot.

Cases: null texts are empty and still predict their end; with nothing to learn
from, every symbol has probability 1/257; rows with a null id are training
documents; rows that share an id are scored each.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ROWS, Row, _table, ask, conclude, dealt, joined, told_of, total_bytes
from .shared import stored
from .text import BYTE_CODES, SPACE, U, as_bytes, mixed, powers, slices, span_hash

ORDER = 5
BITS = 9  # a symbol: 0 is the edge of a text, byte b is b + 1
SYMBOLS = 257
CHUNK_BYTES = 12 << 20
TOKENS, CONTEXTS = 0, 1  # kinds of buckets
LOW32 = U(0xFFFFFFFF)


def is_held_out(doc_id: int | None, folds: int = 10) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def context_keys(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) of every symbol and every end as one integer, and where each text's keys end."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + order + 1)
    symbols = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint16)
    at = np.repeat(ends - sizes - 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    symbols[at] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    keys = np.zeros(max(0, len(symbols) - order), U)
    for j in range(order + 1):
        keys = keys << U(BITS) | symbols[j:len(keys) + j]
    own = np.ones(len(symbols), bool)  # the padding in front of a text is no prediction
    for j in range(order):
        own[ends - sizes - 1 - order + j] = False
    return keys[own[order:]], np.cumsum(sizes + 1)


def bucket_of(keys: np.ndarray, buckets: int, order: int) -> np.ndarray:
    """By the three oldest symbols, so that neighbouring keys of a bucket are alike and compress."""
    return mixed(keys >> U(BITS * max(0, order - 2))) % U(buckets)


def planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second bytes, and so on: sorted keys and small counts compress well this way."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Words of the given sizes that stand behind one another."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Runs of bytes other than white space, and how many each text has."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edges[0::2], edges[1::2]
    bounds = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    return packed(data[inside], end - start), np.diff(bounds, prepend=0)


def lines(data: bytes) -> pa.Array:
    """The words of a question, one a line; the end of a text is an empty one."""
    found = np.frombuffer(data + b"\n", np.uint8)
    inside = found != 10
    return packed(found[inside], np.diff(np.flatnonzero(~inside), prepend=-1) - 1)


def encoded(parts: Iterable[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """Each word's number among the distinct ones, and those; a part at a time, so that not all words are held at once."""
    own, distinct = [], []
    for part in parts:
        found = part.dictionary_encode()
        own.append(found.indices.to_numpy())
        distinct.append(found.dictionary)
    ends = np.cumsum([len(d) for d in distinct])
    whole = pa.concat_arrays(distinct).dictionary_encode()
    number = np.split(whole.indices.to_numpy(), ends[:-1])
    return np.concatenate([n[o] for n, o in zip(number, own)]), whole.dictionary


def hashes(word: pa.Array) -> np.ndarray:
    offsets, data = (np.frombuffer(b, kind) if b else np.zeros(0, kind) for b, kind in zip(word.buffers()[1:], (np.int64, np.uint8)))
    prefix = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_CODES[data] * powers(len(prefix))[0][:len(data)], out=prefix[1:])
    at = offsets[word.offset:word.offset + len(word) + 1]
    return span_hash(prefix, at[:-1], at[1:])


@dataclass
class Tokens:
    """Distinct tokens of a chunk by bucket and text, and the tokens of its texts."""

    words: pa.Array
    counts: np.ndarray  # in training texts
    ends: np.ndarray  # bucket b: words[ends[b]:ends[b + 1]]
    codes: np.ndarray
    spoken: np.ndarray  # codes of all texts' words in order, and of the end last
    sizes: np.ndarray  # words of each text


class Places:
    """Positions of known keys in a sorted array: one probe of a sparse table, a binary search for what it misses."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = keys, U(64 - max(10, (8 * len(keys)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.table[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        at[missed] = np.searchsorted(self.keys, keys[missed])
        return at


class Chunk:
    """Distinct keys and tokens of a chunk, with their training counts, in the order of its questions."""

    def __init__(self, table: pa.Table, buckets: int, order: int):
        self.number = table["chunk"][0].as_py()
        self.ids = table["id"].to_pylist()
        self.texts = [t.lower() for t in as_bytes(table["text"].combine_chunks())]
        self.held = np.array([is_held_out(i) for i in self.ids])
        self.buckets, self.order = buckets, order

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = [], []
        for held in (False, True):
            texts = [t for t, h in zip(self.texts, self.held) if h == held]
            for a, b in slices(texts):
                k, n = np.unique(context_keys(texts[a:b], self.order)[0], return_counts=True)
                keys.append(k)
                counts.append(n.astype(np.int32) * (not held))
        key = np.concatenate(keys)
        keys.clear()
        sort = np.argsort(key).astype(np.int32)
        key = key[sort]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, count = key[first], np.add.reduceat(np.concatenate(counts)[sort], first, dtype=np.int64)
        sort = np.argsort(bucket_of(key, self.buckets, self.order), kind="stable")
        return key[sort], count[sort]

    def tokens(self) -> Tokens:
        sizes = []

        def parts() -> Iterator[pa.Array]:
            for a, b in slices(self.texts):
                found, size = words(self.texts[a:b])
                sizes.append(size)
                yield found
            yield packed(np.zeros(0, np.uint8), np.zeros(1, np.int64))  # the end of a text is a token

        code, word = encoded(parts())
        sizes = np.concatenate(sizes)
        count = np.bincount(code[:-1][np.repeat(~self.held, sizes)], minlength=len(word))
        count[code[-1]] += np.count_nonzero(~self.held)
        bucket = (hashes(word) % U(self.buckets)).astype(np.int64)
        sort = pc.sort_indices(word).to_numpy()
        sort = sort[np.argsort(bucket[sort], kind="stable")]
        ends = np.searchsorted(bucket[sort], np.arange(self.buckets + 1))
        return Tokens(word.take(pa.array(sort)), count[sort], ends, sort, code, sizes)

    def questions(self) -> list[Row]:
        key, count = self.contexts()
        ends = np.searchsorted(bucket_of(key, self.buckets, self.order), np.arange(self.buckets + 1, dtype=U))
        rows = [Row(2 * b + CONTEXTS, self.number, planes(key[i:j]), planes(count[i:j].astype(np.uint32)))
                for b, (i, j) in enumerate(zip(ends[:-1], ends[1:])) if j > i]
        tokens = self.tokens()
        rows += [Row(2 * b + TOKENS, self.number, b"\n".join(tokens.words[i:j].to_pylist()), tokens.counts[i:j].astype(np.uint32).tobytes())
                 for b, (i, j) in enumerate(zip(tokens.ends[:-1], tokens.ends[1:])) if j > i]
        return rows

    def scored(self, told: list[Row]) -> pa.Table:
        """Per document its token figures and log10 probability; ``known`` words of the buckets told to this chunk."""
        key, _ = self.contexts()
        logs = joined([r for r in told if r.bucket % 2 == CONTEXTS], "data", np.float32)
        sort = np.argsort(key)
        key, logs = key[sort], logs[sort].astype(float)
        places = Places(key)
        score = np.zeros(len(self.texts))
        for a, b in slices(self.texts):
            keys, ends = context_keys(self.texts[a:b], self.order)
            total = np.concatenate([[0.0], np.cumsum(logs[places.find(keys)])])[np.concatenate([[0], ends])]
            score[a:b] = np.diff(total)
        tokens, answers = self.tokens(), [r for r in told if r.bucket % 2 == TOKENS]
        times = np.empty(len(tokens.words), np.int64)
        times[tokens.codes] = joined(answers, "data", np.int64)
        logs, known = np.log10(times + 0.1), times > 0
        spoken, end = tokens.spoken[:-1], tokens.spoken[-1]
        ends = np.concatenate([[0], np.cumsum(tokens.sizes)])
        base = [math.fsum([*logs[spoken[a:b]].tolist(), logs[end]]) for a, b in zip(ends[:-1], ends[1:])]
        found = np.diff(np.concatenate([[0], np.cumsum(known[spoken], dtype=np.int32)])[ends]) + int(known[end])
        vocabulary = sum(int(np.frombuffer(r.more, np.int64)[0]) for r in answers)
        return pa.table({"id": self.ids, "held_out": pa.array(self.held), "n_tokens": tokens.sizes + 1, "n_known": found, "logs": base, "score": score,
                         "words": [vocabulary] + [0] * (len(self.ids) - 1)})


COUNTED = "bucket bigint, key bigint, c bigint"


def counted(asked: DataFrame) -> DataFrame:
    """(bucket, key, c): training counts of all keys that any chunk asks for."""
    def run(table: pa.Table) -> pa.Table:
        (_, rows), = told_of(table).items()
        key, where = np.unique(np.concatenate([from_planes(r.data, U) for r in rows]), return_inverse=True)
        count = np.bincount(where, np.concatenate([from_planes(r.more, np.uint32) for r in rows]), len(key)).astype(np.int64)
        return pa.table({"bucket": pa.array(np.full(len(key), rows[0].bucket)), "key": pa.array(key.view(np.int64)), "c": pa.array(count)})

    return asked.where(F.col("bucket") % 2 == CONTEXTS).groupBy("bucket").applyInArrow(run, COUNTED)


def code_lengths(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(bucket, key, log10 probability) of every key, known or not, bottom up over the orders of the trie."""
    symbol = (1 << BITS) - 1
    ctx, sym, c = F.col("ctx"), F.col("sym"), F.col("c")
    wanted = {order: counts.select(F.shiftright("key", BITS).alias("ctx"), F.col("key").bitwiseAND(symbol).alias("sym"), "c", "bucket", "key")}
    for k in range(order - 1, -1, -1):
        mask = (1 << (BITS * k)) - 1
        wanted[k] = stored(wanted[k + 1].groupBy(ctx.bitwiseAND(F.lit(mask)).alias("ctx"), sym.alias("sym")).agg(F.sum("c").alias("c")), f"order{k}")
    # per context: symbols counted and distinct; then the same of the shorter context without the symbols this one has seen
    result = None
    for k in range(order + 1):
        seen = wanted[k].where("c > 0")
        own = seen.groupBy("ctx").agg(F.sum("c").alias("n"), F.count("*").alias("d"))
        down = ctx.bitwiseAND(F.lit((1 << (BITS * max(0, k - 1))) - 1))
        if k == 0:
            # below the empty context: all symbols it has not seen
            contexts = own.withColumn("below_n", F.lit(0)).withColumn("below_d", SYMBOLS - F.col("d"))
        else:
            shorter = wanted[k - 1].where("c > 0")
            excluded = seen.select(ctx, sym, down.alias("down")).join(
                shorter.select(ctx.alias("down"), "sym", c.alias("below_c")), ["down", "sym"]).groupBy("ctx").agg(F.sum("below_c").alias("x"))
            totals = shorter.groupBy(ctx.alias("down")).agg(F.sum("c").alias("down_n"), F.count("*").alias("down_d"))
            contexts = own.join(excluded, "ctx").withColumn("down", down).join(totals, "down").select(
                "ctx", "n", "d", (F.col("down_n") - F.col("x")).alias("below_n"), (F.col("down_d") - F.col("d")).alias("below_d"))
        rows = wanted[k].join(contexts, "ctx", "left")
        left = 2 * F.greatest(F.col("below_n"), F.lit(1))
        if k == 0:
            # after an escape from the empty context, one of the symbols left; with nothing learned, one of all
            escaped = -F.log10(F.greatest(F.col("below_d"), F.lit(1)).cast("double"))
            none = F.lit(-math.log10(SYMBOLS))
        else:
            rows = rows.withColumn("down", down).join(result, ["down", "sym"])
            further = F.when(F.col("below_d") > 0, F.log10(F.col("below_d") / left)).otherwise(F.lit(0.0)) + F.col("down_escaped")
            escaped = F.when(F.col("down_c") > 0, F.log10((2 * F.col("down_c") - 1) / left)).otherwise(further)
            none = F.col("down_entered")
        # entered: coded from this context on; escaped: coded below it, without the symbols it has seen
        rows = rows.withColumn("escaped", escaped)
        size = 2 * F.col("n")
        entered = F.when(F.col("n").isNull(), none).when(c > 0, F.log10((2 * c - 1) / size)).otherwise(
            F.log10(F.col("d") / size) + F.col("escaped"))
        rows = rows.withColumn("entered", entered)
        if k < order:
            result = stored(rows.select(ctx.alias("down"), "sym", c.alias("down_c"), F.col("escaped").alias("down_escaped"),
                                        F.col("entered").alias("down_entered")), f"codes{k}")
    return rows.select("bucket", "key", F.col("entered").alias("log"))


def answered(asked: DataFrame, codes: DataFrame) -> DataFrame:
    """Each question's rows back: code lengths of its keys, or counts of its tokens with the bucket's vocabulary."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([])
        (number, rows), = told_of(left).items()
        out = []
        if rows[0].bucket % 2 == CONTEXTS:
            key, log = right["key"].to_numpy().view(U), right["log"].to_numpy().astype(np.float32)
            sort = np.argsort(key)
            key, log = key[sort], log[sort]
            for r in rows:
                out.append((r.bucket, r.bucket, r.chunk, number, log[np.searchsorted(key, from_planes(r.data, U))].tobytes(), b"", b""))
        else:
            asked_words = [lines(r.data) for r in rows]
            code, word = encoded(asked_words)
            total = np.bincount(code, np.concatenate([np.frombuffer(r.more, np.uint32) for r in rows]), len(word)).astype(np.int64)
            known, at = np.count_nonzero(total), 0
            for r, asked_of in zip(rows, asked_words):  # the first chunk is told how many words the bucket knows
                data = total[code[at:at + len(asked_of)]].tobytes()
                out.append((r.bucket, r.bucket, r.chunk, number, data, np.array([known], np.int64).tobytes(), b""))
                known, at = 0, at + len(asked_of)
        return _table(out)

    # counts of contexts have done their work
    asked = asked.withColumn("more", F.when(F.col("bucket") % 2 == TOKENS, F.col("more")).otherwise(F.lit(b"")))
    return asked.groupBy("bucket").cogroup(codes.groupBy("bucket")).applyInArrow(run, ROWS)


SCORED = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double, words bigint"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and the model's log10 probability ``score``."""
    chunks = max(1, -(-total_bytes(docs, text_col) // chunk_bytes))
    buckets = chunks
    chunked = dealt(docs, id_col, text_col, chunks)
    asked = stored(ask(chunked, None, 1, lambda table, told: Chunk(table, buckets, order).questions()), "asked")
    codes = code_lengths(stored(counted(asked), "counts"), order)
    told = answered(asked, codes)
    scored = stored(conclude(chunked, told, lambda table, told: Chunk(table, buckets, order).scored(told.get(1, [])), SCORED), "scored")
    train = F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.lit(0))
    totals = scored.agg(train.alias("train_tokens"), F.coalesce(F.sum("words"), F.lit(0)).alias("vocabulary"))  # one row
    share = F.log10(F.col("train_tokens") + 0.1 * (F.col("vocabulary") + 1))
    return scored.crossJoin(totals).select("id", "held_out", "n_tokens", "n_known", "train_tokens",
                                           (F.col("logs") - F.col("n_tokens") * share).alias("base_score"), "score")


def report(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text")).withColumnRenamed("id", "doc_id")
