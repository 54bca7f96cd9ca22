"""Phrase collocation mining by Rabin-Karp fingerprints of every n-gram.

Words carry a prefix polynomial, so that the fingerprint of any run of words is
one subtraction in numpy. Chunks of texts reduce their n-grams to sorted
fingerprints with saturated counts and put them to buckets of the fingerprint
space; a bucket answers each chunk with those that are frequent over all chunks.
The row of a chunk is the occurrence pointer: a frequent fingerprint is looked
up again where the chunk holds it, each of its occurrences is compared with the
text of the first, and only then does a phrase become text. The bucket sums its
counts by text and only frequent ones become rows, so colliding fingerprints
cost a few phrases too many on the way and never a wrong count. A phrase can only be frequent if the two phrases one word
shorter are, which keeps rare words out of the longer rounds.

Memory follows the chunk (``chunk_bytes``) or the longest piece of text, and a
bucket holds one entry per chunk and fingerprint, however often it occurs.

Cases: null and empty texts have no words; a null lang is ``und``; rows alike
in every column count as often as they occur, and are spread by the partition
they come from; pieces of any length are taken whole; an empty table gives an
empty result. Only id, text and lang are read, so other columns never clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import ROWS, Row, _table, answer, ask, conclude, joined, split, total_bytes
from .shared import stored
from .text import SLICE, U, as_bytes, mixed, powers, span_hash, words_of

LONGEST = 5
CHUNK_BYTES = 12 << 20
UNKNOWN = "und"

_DELIMITERS = b".,;:!?\n\x0b\x0c\r"
DELIMITER = np.zeros(256, bool)
DELIMITER[list(_DELIMITERS)] = True
IN_WORD = ~DELIMITER
IN_WORD[[0x20, 0x09]] = False

FOUND = "lang string, phrase string, words int, times bigint"


def bucket_count(chunks: int) -> int:
    """As many as chunks; beyond 4096 their root decides, so that a question keeps a payload of its own."""
    return chunks if chunks <= 4096 else 64 * int(chunks ** 0.5)


# -- a chunk as arrays of words -------------------------------------------------------
def parts_of(text: bytes, limit: int = SLICE) -> Iterator[bytes]:
    """The text cut behind delimiters into parts of about ``limit`` bytes: no phrase crosses a delimiter."""
    at = 0
    while len(text) - at > limit:
        ends = np.flatnonzero(DELIMITER[np.frombuffer(text, np.uint8, count=min(2 * limit, len(text) - at) - limit, offset=at + limit)])
        if len(ends):
            end = at + limit + int(ends[0]) + 1
        else:
            rest = np.frombuffer(text, np.uint8, offset=min(at + 2 * limit, len(text)))
            ends = np.flatnonzero(DELIMITER[rest])
            end = len(text) - len(rest) + int(ends[0]) + 1 if len(ends) else len(text)
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


class ChunkWords:
    """All words of a chunk: code, place in ``data``, piece and language of each."""

    def __init__(self, table: pa.Table):
        names = [UNKNOWN if v is None else v for v in table["lang"].to_pylist()]
        self.langs = sorted(set(names))
        number = {v: i for i, v in enumerate(self.langs)}
        seeds = np.array([int.from_bytes(blake2b(v.encode(), digest_size=8).digest(), "little") for v in self.langs], U)
        data, code, start, size, piece, lang = [], [], [], [], [], []
        offset = pieces = 0
        wide = np.int32 if 2 * table.nbytes < 1 << 31 else np.int64  # places within the chunk
        for texts, of in self._slices(as_bytes(table["text"]), [number[v] for v in names]):
            w = words_of(texts, IN_WORD)
            inside = np.cumsum(DELIMITER[w.data])
            lang.append(np.repeat(np.array(of, np.int32), np.diff(w.bounds)))
            code.append(mixed(w.hash + seeds[lang[-1]]))
            start.append((w.start + offset).astype(wide))
            size.append((w.end - w.start).astype(np.int32))
            piece.append((inside[w.start] + pieces).astype(wide))
            data.append(w.data)
            offset += len(w.data)
            pieces += int(inside[-1]) + 1
        join = lambda found, kind: np.concatenate(found) if found else np.zeros(0, kind)
        self.data, self.code, self.start = join(data, np.uint8), join(code, U), join(start, np.int32)
        self.size, self.piece, self.lang = join(size, np.int32), join(piece, np.int32), join(lang, np.int32)
        self.prefix = np.zeros(len(self.code) + 1, U)
        np.cumsum(self.code * powers(len(self.code) + 1)[0][: len(self.code)], out=self.prefix[1:])

    @staticmethod
    def _slices(texts: list[bytes], lang: list[int]) -> Iterator[tuple[list[bytes], list[int]]]:
        held, of, size = [], [], 0
        for text, number in zip(texts, lang):
            for part in parts_of(text):
                held.append(part)
                of.append(number)
                size += len(part) + 1
                if size >= SLICE:
                    yield held, of
                    held, of, size = [], [], 0
        if held:
            yield held, of

    def starts(self, length: int) -> np.ndarray:
        """Positions where a phrase of ``length`` words begins: one piece holds it all."""
        n = max(0, len(self.code) - length + 1)
        return np.flatnonzero(self.piece[:n] == self.piece[length - 1:length - 1 + n])

    def keys(self, at: np.ndarray, length: int, buckets: int) -> np.ndarray:
        """Fingerprints of the phrases at these positions: the bucket in the upper 32 bits."""
        h = span_hash(self.prefix, at, at + length)
        return (((h >> U(32)) * U(buckets)) >> U(32)) << U(32) | (h & U(0xFFFFFFFF))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the ascending ``known``."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def extended(words: ChunkWords, shorter: np.ndarray, length: int) -> np.ndarray:
    """Starts of ``length`` words whose two phrases of one word less start at ``shorter``."""
    ok = np.zeros(len(words.code) + 1, bool)
    ok[shorter] = True
    at = words.starts(length)
    return at[ok[at] & ok[at + 1]]


# -- rounds ------------------------------------------------------------------------
def questions(chunk: int, keys: np.ndarray, buckets: int, least: int) -> list[Row]:
    """Distinct fingerprints with their counts, which need not pass ``least``."""
    known, times = np.unique(keys, return_counts=True)
    times = np.minimum(times, least).astype(np.uint32)
    return [Row(b, chunk, (known[i:j] & U(0xFFFFFFFF)).astype(np.uint32).tobytes(), _packed(times[i:j])) for b, i, j in split(known, buckets)]


def _packed(times: np.ndarray) -> bytes:
    """A byte for each count; those over 254 follow in four."""
    small = np.minimum(times, 255).astype(np.uint8)
    return small.tobytes() + times[small == 255].astype(np.uint32).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    times = np.frombuffer(data, np.uint8, n).astype(np.int64)
    times[times == 255] = np.frombuffer(data, np.uint32, offset=n)
    return times


def frequent(rows: list[Row], least: int) -> list[Row]:
    """For each question the fingerprints that reach ``least`` over all chunks."""
    sizes = [len(r.data) // 4 for r in rows]
    keys = joined(rows, "data", np.uint32)
    times = np.concatenate([_unpacked(r.more, n) for r, n in zip(rows, sizes)])
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.diff(keys[order], prepend=np.uint32(0)) != 0) if len(keys) else np.zeros(0, np.int64)
    new = np.union1d(new, [0]).astype(np.int64)
    total = np.add.reduceat(times[order], new)
    often = np.zeros(len(keys), bool)
    often[order] = np.repeat(total >= least, np.diff(np.append(new, len(keys))))
    at = np.cumsum([0, *sizes])
    return [Row(r.bucket, r.chunk, keys[i:j][often[i:j]].tobytes()) for r, i, j in zip(rows, at, at[1:])]


def told_keys(told: dict[int, list[Row]]) -> np.ndarray:
    found = [np.frombuffer(r.data, np.uint32).astype(U) | U(r.bucket) << U(32) for rows in told.values() for r in rows]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, U)


def materialised(words: ChunkWords, at: np.ndarray, keys: np.ndarray, length: int, ids: np.ndarray) -> Iterator[tuple[int, int, bytes, int]]:
    """(bucket, lang, phrase, times) of the occurrences, told apart by their words and not by their fingerprints.

    ``ids`` numbers the frequent words of the chunk by text; a phrase with another word
    only collides with a frequent one. Occurrences that differ from the first of their
    fingerprint are counted one by one.
    """
    common = np.ones(len(at), bool)
    for j in range(length):
        common &= ids[at + j] >= 0
    at, keys = at[common], keys[common]
    if not len(at):
        return
    known, first, group = np.unique(keys, return_index=True, return_inverse=True)
    leader = at[first]
    same = np.ones(len(at), bool)
    for j in range(length):
        same &= ids[at + j] == ids[leader[group] + j]
    times = np.bincount(group[same], minlength=len(known))
    buckets = (known >> U(32)).tolist()
    for b, p, n in zip(buckets, leader.tolist(), times.tolist()):
        yield b, int(words.lang[p]), _phrase(words, p, length), n
    odd = Counter((buckets[g], int(words.lang[p]), _phrase(words, p, length)) for p, g in zip(at[~same].tolist(), group[~same].tolist()))
    for (b, lang, phrase), n in odd.items():
        yield b, lang, phrase, n


def packed_phrases(words: ChunkWords, chunk: int, found: Iterator[tuple[int, int, bytes, int]]) -> list[Row]:
    """One row per bucket and language: phrases by line (no phrase holds a line end), their counts, the language."""
    held: dict[tuple[int, int], tuple[list[bytes], list[int]]] = {}
    for b, lang, phrase, n in found:
        lines, times = held.setdefault((b, lang), ([], []))
        lines.append(phrase)
        times.append(n)
    return [Row(b, chunk, b"\n".join(lines), np.array(times, np.int64).tobytes(), words.langs[lang].encode())
            for (b, lang), (lines, times) in held.items()]


def summed_phrases(table: pa.Table, least: int) -> pa.Table:
    """Counts of a bucket's phrases over all chunks, by text: those that reach ``least``, and the numbers of all words."""
    total: dict[bytes, Counter] = {}
    for lang, lines, times in zip(*[table[n].to_pylist() for n in ("last", "data", "more")]):
        count = total.setdefault(lang, Counter())
        for phrase, n in zip(lines.split(b"\n"), np.frombuffer(times, np.int64).tolist()):
            count[phrase] += n
    out = [(lang.decode("utf-8", "replace"), phrase.decode("utf-8", "replace") or None, phrase.count(b" ") + 1, n)
           for lang, count in total.items() for phrase, n in count.items() if n >= least or not phrase]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64()]
    columns = list(zip(*out)) or [()] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "phrase", "words", "times"])


def _phrase(words: ChunkWords, p: int, length: int) -> bytes:
    return b" ".join(words.data[s:s + n].tobytes() for s, n in zip(words.start[p:p + length].tolist(), words.size[p:p + length].tolist()))


def word_ids(words: ChunkWords, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A number per distinct (language, word) at these positions, decided by comparing texts; -1 elsewhere."""
    ids = np.full(len(words.code) + 1, -1, np.int64)
    if not len(at):
        return ids
    known, first, group = np.unique(keys, return_index=True, return_inverse=True)
    leader = at[first][group]
    same = (words.size[at] == words.size[leader]) & (words.lang[at] == words.lang[leader])
    step = max(1, (4 << 20) // int(words.size[at].max()))
    for i in range(0, len(at), step):
        a, b, n = at[i:i + step], leader[i:i + step], np.where(same[i:i + step], words.size[at[i:i + step]], 0)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differs = words.data[np.repeat(words.start[a], n) + within] != words.data[np.repeat(words.start[b], n) + within]
        wrong = np.unique(np.repeat(np.arange(len(a)), n)[differs])
        same[i + wrong] = False
    ids[at] = group
    fresh: dict[tuple[int, bytes], int] = {}
    for p in at[~same].tolist():
        ids[p] = fresh.setdefault((int(words.lang[p]), _phrase(words, p, 1)), len(known) + len(fresh))
    return ids


def phrase_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = 100,
                  longest: int = LONGEST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, phrase, words, times) of all phrases up to ``longest`` words that occur ``least`` times in their language;
    a row with a null phrase has the number of all words of the language."""
    chunks = max(1, -(-total_bytes(docs, text_col) // chunk_bytes))
    buckets = bucket_count(chunks)
    lang, text = F.coalesce(F.col(lang_col), F.lit(UNKNOWN)), F.col(text_col)
    # equal rows are spread by the partition that reads them, which a retried task does not change
    chunk = F.pmod(F.xxhash64(F.col(id_col), text, F.spark_partition_id()), F.lit(chunks))
    dealt = docs.select(chunk.alias("chunk"), lang.alias("lang"), text.alias("text")).repartition(chunks, "chunk")

    def first_round(left: pa.Table, told) -> list[Row]:
        words = ChunkWords(left)
        keys = [words.keys(words.starts(n), n, buckets) for n in (1, 2)]
        return questions(left["chunk"][0].as_py(), np.concatenate(keys), buckets, least)

    def second_round(left: pa.Table, told) -> list[Row]:
        words, known = ChunkWords(left), told_keys(told)
        at = words.starts(2)
        at, keys = at[_among(words.keys(at, 2, buckets), known)], [np.zeros(0, U)]
        for n in range(3, longest + 1):
            at = extended(words, at, n)
            keys.append(words.keys(at, n, buckets))
        return questions(left["chunk"][0].as_py(), np.concatenate(keys), buckets, least)

    def last_round(left: pa.Table, told) -> pa.Table:
        words, known = ChunkWords(left), told_keys(told)
        chunk = left["chunk"][0].as_py()

        def found() -> Iterator[tuple[int, int, bytes, int]]:
            for i, n in enumerate(np.bincount(words.lang, minlength=len(words.langs)).tolist()):
                yield 0, i, b"", n
            at, ids = words.starts(1), np.zeros(0)
            for n in range(1, longest + 1):
                at = at if n == 1 else extended(words, at, n)
                keys = words.keys(at, n, buckets)
                often = _among(keys, known)
                at, keys = at[often], keys[often]
                ids = word_ids(words, at, keys) if n == 1 else ids
                yield from materialised(words, at, keys, n, ids)

        return _table([(r.bucket, r.bucket, r.chunk, 3, r.data, r.more, r.last) for r in packed_phrases(words, chunk, found())])

    judge: Callable = lambda rows: frequent(rows, least)
    told = answer(ask(dealt, None, 1, first_round), judge)
    told = answer(ask(dealt, told, 2, second_round), judge)
    found = conclude(dealt, told, last_round, ROWS)
    return found.groupBy("key").applyInArrow(lambda table: summed_phrases(table, least), FOUND)


# -- collocations ---------------------------------------------------------------------
def whole(value: Column, digits: int) -> Column:
    return value.cast(f"decimal({digits},0)")


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = 100, top: int = 2000,
                 covered_percent: int = 100, longest: int = LONGEST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The ``top`` phrases of each language by the score of their weakest cut.

    A phrase goes where one a word longer occurs ``covered_percent`` as often; longer
    ones need no look, since what lies between occurs at least as often as they do.
    """
    counts = stored(phrase_counts(docs, id_col, text_col, lang_col, least, longest, chunk_bytes), "phrases")
    known = counts.where("phrase IS NOT NULL")
    totals = counts.where("phrase IS NULL").select("lang", F.col("times").alias("n"))
    candidates = known.where("words > 1").withColumn("_w", F.split("phrase", " ", -1))
    join = lambda words: F.array_join(words, " ")
    cuts = candidates.select(
        "lang", "phrase", "words", F.col("times").alias("a"), "_w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "words", "a", "k", join(F.slice("_w", 1, F.col("k"))).alias("_left"),
        join(F.slice("_w", F.col("k") + 1, F.col("words") - F.col("k"))).alias("_right"))
    side = lambda name, times: known.select("lang", F.col("phrase").alias(name), F.col("times").alias(times))
    cuts = cuts.join(side("_left", "l"), ["lang", "_left"]).join(side("_right", "r"), ["lang", "_right"]).join(totals, "lang")
    # a decimal holds 38 digits: both products stay below that for counts of 17 digits
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)))"
                   " div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    shorter = F.explode(F.array(join(F.slice("_w", 1, F.col("words") - 1)), join(F.slice("_w", 2, F.col("words") - 1))))
    over = candidates.where("words > 2").select("lang", shorter.alias("phrase"), "times").groupBy("lang", "phrase").agg(
        F.max("times").alias("_over"))
    left = scored.join(over, ["lang", "phrase"], "left").where(
        F.col("_over").isNull() | (100 * whole(F.col("_over"), 18) < covered_percent * whole(F.col("a"), 18)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase")))
    return left.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def report(docs: DataFrame) -> DataFrame:
    return collocations(docs)


_WORDS = r"list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '')"
SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, {_WORDS} AS w FROM pieces WHERE piece <> ''),
totals AS (SELECT lang, sum(len(w))::bigint AS n FROM worded GROUP BY 1),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*)::bigint AS times FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, k AS m, phrase, string_split(phrase, ' ') AS w, times AS a FROM f WHERE k > 1),
cuts AS (SELECT lang, m, phrase, a, unnest(range(1, m)) AS k, w FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.m, c.a, c.k, x.times AS l, y.times AS r, n,
         ((1000::hugeint * c.a * n) // (x.times::hugeint * y.times))::bigint AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:c.k], ' ') AND x.k = c.k
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[c.k + 1:m], ' ') AND y.k = m - c.k JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
over AS (
  SELECT DISTINCT s.lang, s.phrase FROM cand s JOIN (
    SELECT lang, a, unnest([array_to_string(w[1:m - 1], ' '), array_to_string(w[2:m], ' ')]) AS inner_phrase FROM cand WHERE m > 2) g
  ON g.lang = s.lang AND g.inner_phrase = s.phrase AND g.a >= s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest ANTI JOIN over USING (lang, phrase) QUALIFY rank <= 2000"""
