"""Repeated substrings across documents by bucket-pointer refinement.

Removed is each byte covered by a string of ``LENGTH`` bytes that also starts in
a document with a smaller id. The suffixes that can begin such a string are
found by their q-gram buckets, and the buckets are refined by the identifiers of
later offsets:

1. Of the q-grams inside each window of LENGTH bytes, the one with the least hash
   stands for it (equal windows choose equal q-grams), so about one q-gram in
   fourteen is looked up. Chunks ask which of these q-gram buckets hold several
   documents.
2. Windows of one q-gram lie side by side and form a segment of up to
   2 * LENGTH - q bytes. For shared q-grams, chunks ask for the least document of
   each segment; where it is smaller, the whole segment repeats.
3. Of q-grams with different segments (where a repeated passage begins or ends),
   one copy of each segment goes to the bucket as text. There the suffixes are
   sorted by bucket-pointer refinement: buckets of eight bytes are refined by the
   bucket identifiers 8, 16 and then 18 bytes later, each pass using the
   identifiers the pass before has updated, until a bucket is one string of LENGTH
   bytes; its least document decides for each window.

Inside a hot passage there is one entry per chunk at every step. At its ends the
segments hold the documents' own bytes and differ, so the entries of a q-gram that
stands in more than ``MANY`` places are dealt by their content instead: round 2 by the
segment's hash, and in round 3 each window's hash (one entry per chunk with its
least document) asks in a bucket of its own. No bucket follows the number of documents.

Segments, and windows of hot q-grams, are compared by 64 bits
of their own and by their q-gram's hash.

Cases: null texts are empty; texts shorter than LENGTH lose nothing; rows with a
null id lose nothing and take nothing from others; rows that share an id take
nothing from each other; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import Row, answer, ask, conclude, dealt, joined, split, total_bytes
from .text import BYTE_CODES, U, as_bytes, mixed

LENGTH, Q = 50, 24
SPREAD = LENGTH - Q + 1  # q-grams in a window; windows of one q-gram
SEGMENT = 80  # bytes of a padded segment: at least 2 * LENGTH - Q
PIECE = 1 << 20
POSITION = U((1 << 24) - 1)
CHUNK_BYTES = 6 << 20
MANY = 4096  # places of a q-gram from which its entries are dealt by content
_step = mixed(np.arange(1, 6, dtype=U) * U(0x2545F4914F6CDD1D)) | U(1)
_word = mixed(np.arange(1, SEGMENT // 8 + 2, dtype=U) * U(0x9FB21C651E98DF25)) | U(1)


def qgram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes from each position, by doubling: 1, 2, 4, 8, 16, then 16 + 8."""
    h = BYTE_CODES[data]
    eight = h
    for k, width in enumerate((1, 2, 4, 8)):
        if width == 8:
            eight = h
        h = h[:-width] * _step[k] + h[width:]
    return mixed(h[:-8] * _step[4] + eight[16:])


def sliding_least(x: np.ndarray, width: int = SPREAD) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have:]) if width > have else x


class Chunk:
    """A chunk's texts as segments: runs of windows that one q-gram stands for."""

    def __init__(self, table: pa.Table, buckets: int):
        self.buckets = buckets
        self.ids = table["id"].to_pylist()
        self.texts = as_bytes(table["text"].combine_chunks())
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0, self.texts[i]))
        self.ids, self.texts = [self.ids[i] for i in order], [self.texts[i] for i in order]
        self.number = table["chunk"][0].as_py()
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"".join(self.texts) + bytes(SEGMENT), np.uint8)
        owner, at, pieces = [], [], []
        for i, t in enumerate(self.texts):
            if self.ids[i] is not None:
                for p in range(0, len(t) - LENGTH + 1, PIECE):
                    owner.append(i)
                    at.append(int(self.base[i]) + p)
                    pieces.append(min(len(t) - p, PIECE + LENGTH - 1))
        found = [self._segments(at[a:b], pieces[a:b], owner[a:b]) for a, b in _groups(pieces)]
        none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U)]
        self.doc, self.low, self.high, self.key = (np.concatenate(c) for c in zip(none, *found))
        ids = np.array([-1 if i is None else i for i in self.ids], np.int64)
        self.id = ids[self.doc] if len(ids) else np.zeros(0, np.int64)

    def _segments(self, at: list[int], sizes: list[int], owner: list[int]) -> tuple[np.ndarray, ...]:
        """Document, first and last window start (in the chunk's bytes) and key of each segment of neighbouring pieces."""
        data = np.concatenate([self.data[p:p + n] for p, n in zip(at, sizes)])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        hashes = qgram_hashes(data)
        least = sliding_least(hashes & ~POSITION | np.arange(len(hashes), dtype=U))
        starts = np.arange(len(data) - LENGTH + 1)
        starts = starts[starts + LENGTH <= np.repeat(ends, sizes)[: len(starts)]]
        gram = (least[starts] & POSITION).astype(np.int64)
        cut = np.flatnonzero(np.diff(gram, prepend=-1))
        last = np.append(cut[1:], len(starts)) - 1
        piece = np.searchsorted(ends, starts[cut], "right")
        shift = (np.array(at) - begins)[piece]
        h = hashes[gram[cut]]
        key = ((h >> U(32)) % U(self.buckets)) << U(32) | h & U(0xFFFFFFFF)
        return np.array(owner)[piece], starts[cut] + shift, starts[last] + shift, key

    def matrix(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of segments, padded with zeros, and their lengths."""
        size = self.high[which] - self.low[which] + LENGTH
        column = np.arange(SEGMENT)
        out = self.data[self.low[which][:, None] + column]
        out[column[None] >= size[:, None]] = 0
        return out, size

    # -- round 1: which q-gram buckets hold several documents
    def grams(self) -> None:
        order = np.lexsort((self.id, self.key))
        key, id_ = self.key[order], self.id[order]
        first = np.flatnonzero(np.diff(key, prepend=U(0)) != 0) if len(key) else np.zeros(0, int)
        if len(key) and (not len(first) or first[0] != 0):
            first = np.concatenate([[0], first])
        self.gram = key[first]
        last = np.append(first[1:], len(key)) - 1 if len(first) else first
        self.several = id_[first] != id_[last]
        self.places = np.minimum(last - first + 1, 0xFFFF).astype(np.uint16)

    def ask_grams(self) -> list[Row]:
        low = (self.gram & U(0xFFFFFFFF)).astype(np.uint32)
        return [Row(b, self.number, low[i:j].tobytes(), self.places[i:j].tobytes()) for b, i, j in split(self.gram, self.buckets)]

    # -- round 2: the least document of each segment of a shared bucket
    def entries(self, told: list[Row]) -> None:
        sizes = [j - i for _, i, j in split(self.gram, self.buckets)]
        bits = lambda field: np.concatenate([
            np.unpackbits(np.frombuffer(getattr(r, field), np.uint8))[:n] for r, n in zip(told, sizes)]).astype(bool) if sizes else np.zeros(0, bool)
        shared, hot = bits("data") | self.several, bits("more")
        at = np.searchsorted(self.gram, self.key)
        self.used = np.flatnonzero(shared[at]) if len(self.key) else at
        mark = np.zeros(len(self.used), U)
        for k in range(0, len(self.used), 1 << 16):
            data, size = self.matrix(self.used[k:k + (1 << 16)])
            words = data.view(U)
            total = size.astype(U) * _word[-1]
            for j in range(words.shape[1]):
                total = mixed(total ^ words[:, j] * _word[j])
            mark[k:k + (1 << 16)] = total
        key, id_ = self.key[self.used], self.id[self.used]
        self.hot = hot[at[self.used]] if len(self.used) else np.zeros(0, bool)
        key = np.where(self.hot, (mark >> U(32)) % U(self.buckets) << U(32) | key & U(0xFFFFFFFF), key)
        order = np.lexsort((self.low[self.used], id_, mark, self.hot, key))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(mark[order]) != 0) | (self.hot[order][1:] != self.hot[order][:-1])
        self.entry = np.zeros(len(order), np.int64)  # of each used segment
        self.entry[order] = np.cumsum(new) - 1
        self.lead = self.used[order[new]]  # the first segment of each entry, in its least document
        self.mark, self.place, self.hot = mark[order[new]], key[order[new]], self.hot[order[new]]

    def ask_segments(self) -> list[Row]:
        low = (self.place & U(0xFFFFFFFF)).astype(np.uint32)
        return [Row(b, self.number, low[i:j].tobytes(), self.mark[i:j].tobytes(), self.id[self.lead[i:j]].tobytes())
                for b, i, j in split(self.place, self.buckets)]

    # -- round 3: single windows of segments that only begin or end like others
    def odd(self, told: list[Row]) -> None:
        self.code = joined(told, "data", np.uint8)
        self.sent = np.flatnonzero((self.code == 2) & ~self.hot)
        self._windows(np.flatnonzero((self.code != 1) & self.hot))

    def _windows(self, entries: np.ndarray) -> None:
        """The windows of these entries' first segments, and one question for each different one, in its least document."""
        lead = self.lead[entries]
        count = self.high[lead] - self.low[lead] + 1
        self.window_entry = np.repeat(entries, count)
        self.window_at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = self.low[self.lead[self.window_entry]] + self.window_at
        gram = self.key[self.lead[self.window_entry]] & U(0xFFFFFFFF)
        mark = np.zeros(len(start), U)
        for k in range(0, len(start), 1 << 16):
            data = np.zeros((len(start[k:k + (1 << 16)]), LENGTH + 6), np.uint8)
            data[:, :LENGTH] = self.data[start[k:k + (1 << 16)][:, None] + np.arange(LENGTH)]
            total = gram[k:k + (1 << 16)] * _word[-1]
            for j, word in enumerate(data.view(U).T):
                total = mixed(total ^ word * _word[j])
            mark[k:k + (1 << 16)] = total
        key = (mark >> U(32)) % U(self.buckets) << U(32) | gram
        id_ = self.id[self.lead[self.window_entry]]
        order = np.lexsort((id_, mark, key))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(mark[order]) != 0)
        self.window = np.zeros(len(order), np.int64)  # of each window, the question
        self.window[order] = np.cumsum(new) - 1
        first = order[new]
        self.window_key, self.window_mark, self.window_id = key[first], mark[first], id_[first]
        self.window_later = id_ > self.window_id[self.window]

    def ask_windows(self) -> list[Row]:
        lead = self.lead[self.sent]
        out = []
        for b, i, j in split(self.key[lead], self.buckets):
            data, size = self.matrix(lead[i:j])
            out.append(Row(b, self.number, data.tobytes(), size.astype(np.int32).tobytes(), self.id[lead[i:j]].tobytes()))
        low = (self.window_key & U(0xFFFFFFFF)).astype(np.uint32)
        for b, i, j in split(self.window_key, self.buckets):  # buckets of their own, behind those of the texts
            out.append(Row(self.buckets + b, self.number, low[i:j].tobytes(), self.window_mark[i:j].tobytes(), self.window_id[i:j].tobytes()))
        return out

    def covered(self, told: list[Row]) -> np.ndarray:
        """Which bytes of the chunk are removed."""
        masks = np.zeros(len(self.code), np.uint32)
        masks[self.sent] = joined([r for r in told if r.bucket < self.buckets], "data", np.uint32)
        again = joined([r for r in told if r.bucket >= self.buckets], "data", np.uint8) == 1
        again = again[self.window] | self.window_later
        np.bitwise_or.at(masks, self.window_entry[again], np.uint32(1) << self.window_at[again].astype(np.uint32))
        whole = (self.code[self.entry] == 1) | (self.id[self.used] > self.id[self.lead][self.entry])
        full = self.used[whole]
        starts, ends = [self.low[full]], [self.high[full] + LENGTH]
        part = np.flatnonzero(~whole & (masks[self.entry] != 0))
        for k in range(SPREAD):
            at = self.low[self.used[part[(masks[self.entry[part]] >> np.uint32(k)) & np.uint32(1) == 1]]] + k
            starts.append(at)
            ends.append(at + LENGTH)
        size = len(self.data) + 1
        edge = np.bincount(np.concatenate(starts), minlength=size) - np.bincount(np.concatenate(ends), minlength=size)
        return np.cumsum(edge[:-1]) > 0


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring pieces of about a megabyte."""
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > PIECE:
            yield first, i
            first, total = i, 0
        total += n
    if sizes:
        yield first, len(sizes)


def shared_grams(rows: list[Row], many: int = MANY) -> list[Row]:
    """Two bits per q-gram of a question: do several chunks hold it, and does it stand in more than ``many`` places?"""
    value = joined(rows, "data", np.uint32)
    order = np.argsort(value, kind="stable")
    first = np.flatnonzero(np.diff(value[order], prepend=-1)) if len(value) else order
    size = np.diff(first, append=len(value))
    places = np.add.reduceat(joined(rows, "more", np.uint16)[order].astype(np.int64), first) if len(value) else size
    several, hot = np.zeros(len(value), bool), np.zeros(len(value), bool)
    several[order] = np.repeat(size > 1, size)
    hot[order] = np.repeat(places > many, size)
    told = zip(_dealt_back(rows, several, 4, np.packbits), _dealt_back(rows, hot, 4, np.packbits))
    return [Row(a.bucket, a.chunk, a.data, b.data) for a, b in told]


def _dealt_back(rows: list[Row], values: np.ndarray, width: int, shape=lambda x: x, field: str = "data") -> list[Row]:
    ends = np.cumsum([len(getattr(r, field)) // width for r in rows])
    return [Row(r.bucket, r.chunk, shape(v).tobytes()) for r, v in zip(rows, np.split(values, ends[:-1]))]


def least_documents(rows: list[Row]) -> list[Row]:
    """Per segment: 1 if a smaller document holds it; 2 if not and its q-gram has other segments, too; else 0."""
    key, mark, id_ = joined(rows, "data", np.uint32), joined(rows, "more", U), joined(rows, "last", np.int64)
    order = np.lexsort((id_, mark, key))
    key, mark = key[order], mark[order]
    other_key, other_mark = np.ones(len(order), bool), np.ones(len(order), bool)
    other_key[1:] = key[1:] != key[:-1]
    other_mark[1:] = other_key[1:] | (mark[1:] != mark[:-1])
    group = np.cumsum(other_key) - 1
    several = np.bincount(group, other_mark) > 1
    id_ = id_[order]
    least = id_[other_mark][np.cumsum(other_mark) - 1]  # rows that share an id take nothing from each other
    code = np.zeros(len(order), np.uint8)
    code[order] = np.where(id_ > least, 1, np.where(several[group], 2, 0))
    return _dealt_back(rows, code, 4)


def refined_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the LENGTH-byte strings in ``data`` by bucket-pointer refinement.

    Positions with fewer bytes left in their segment get identifiers, too, which nobody asks for.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.zeros(n, U)
    for k in range(8):
        eight = eight << U(8) | padded[k:k + n].astype(U)
    order = np.argsort(eight, kind="stable")
    bucket = _pointers(order, eight[order])
    for offset in (8, 16, LENGTH - 32):
        crowded = np.flatnonzero(np.bincount(bucket, minlength=n)[bucket] > 1)
        if not len(crowded):
            break
        later = bucket[np.minimum(crowded + offset, n - 1)]
        pair = bucket[crowded].astype(U) * U(n + 1) + later.astype(U)
        order = np.argsort(pair, kind="stable")
        rank = _pointers(order, pair[order])
        # a bucket's members stay behind its pointer; the refined ones are told apart by their place in it
        base = np.full(n, n, np.int64)
        np.minimum.at(base, bucket[crowded], rank)
        bucket = bucket.copy()
        bucket[crowded] = bucket[crowded] + rank - base[bucket[crowded]]
    return bucket


def _pointers(order: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each position the rank at which its run of equal sorted values begins."""
    new = np.ones(len(order), bool)
    new[1:] = values[1:] != values[:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.zeros(len(order), np.int64)
    out[order] = begin
    return out


def repeated_windows(rows: list[Row]) -> list[Row]:
    """A bit per window of each segment: does a smaller document hold the same LENGTH bytes?"""
    data, size, id_ = joined(rows, "data", np.uint8), joined(rows, "more", np.int32), joined(rows, "last", np.int64)
    bucket = refined_buckets(data)
    column = np.arange(SEGMENT)
    usable = (column[None] + LENGTH <= size[:, None]).ravel()
    places = np.flatnonzero(usable)
    owner = id_[places // SEGMENT]
    least = np.full(len(data), np.iinfo(np.int64).max)
    np.minimum.at(least, bucket[places], owner)
    again = least[bucket[places]] < owner
    masks = np.zeros(len(size), np.uint32)
    np.bitwise_or.at(masks, places[again] // SEGMENT, np.uint32(1) << (places[again] % SEGMENT).astype(np.uint32))
    return _dealt_back(rows, masks, 4, field="more")


RESULT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True,
                   chunk_bytes: int = CHUNK_BYTES, many: int = MANY) -> DataFrame:
    """One row per document: sizes, removed spans (start, end, start, end, ...), and the kept bytes if wanted."""
    chunks = max(1, -(-total_bytes(docs, text_col) // chunk_bytes))
    buckets = max(1, -(-chunks // 2))
    chunked = dealt(docs, id_col, text_col, chunks)

    def upto(table: pa.Table, told: dict[int, list[Row]], number: int) -> Chunk:
        """A chunk as it stands after so many rounds of answers."""
        chunk = Chunk(table, buckets)
        chunk.grams()
        if number > 0:
            chunk.entries(told.get(1, []))
        if number > 1:
            chunk.odd(told.get(2, []))
        return chunk

    def result(table: pa.Table, told: dict[int, list[Row]]) -> pa.Table:
        chunk = upto(table, told, 2)
        gone = chunk.covered(told.get(3, []))
        out = []
        for i, text in enumerate(chunk.texts):
            cut = gone[chunk.base[i]: chunk.base[i] + len(text)]
            spans = np.flatnonzero(np.diff(cut, prepend=False, append=False))
            kept = text if not len(spans) else np.frombuffer(text, np.uint8)[~cut].tobytes()
            out.append((chunk.ids[i], len(text), len(text) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest(),
                        spans.tolist(), kept if with_bytes else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in RESULT.split(", ")])

    told = answer(ask(chunked, None, 1, lambda table, told: upto(table, told, 0).ask_grams()), lambda rows: shared_grams(rows, many))
    told = answer(ask(chunked, told, 2, lambda table, told: upto(table, told, 1).ask_segments()), least_documents)
    told = answer(ask(chunked, told, 3, lambda table, told: upto(table, told, 2).ask_windows()),
                  lambda rows: (repeated_windows if rows[0].bucket < buckets else least_documents)(rows))
    return conclude(chunked, told, result, RESULT)


def report(docs: DataFrame) -> DataFrame:
    found = remove_repeats(docs.select("doc_id", "text"), with_bytes=False)
    return found.selectExpr("id AS doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
strings AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM docs, unnest(range(0, n - 49)) t(p) WHERE n >= 50),
firsts AS (SELECT s, min(doc_id) AS first FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before
         FROM strings JOIN firsts USING (s) WHERE doc_id > first),
numbered AS (SELECT *, count(*) FILTER (before IS NULL OR p > before + 50) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits),
runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS e FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT r.doc_id, a, e, substr(h, 2 * coalesce(lag(e) OVER w, 0) + 1, 2 * (a - coalesce(lag(e) OVER w, 0))) AS kept,
                n, h FROM runs r JOIN docs d USING (doc_id) WINDOW w AS (PARTITION BY r.doc_id ORDER BY a)),
cut AS (SELECT doc_id, sum(e - a)::bigint AS n_removed, count(*) AS n_spans,
               string_agg(kept, '' ORDER BY a) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM gaps GROUP BY doc_id)
SELECT doc_id, n::bigint AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)"""
