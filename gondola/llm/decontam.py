"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every n-gram of a test item is a seed, and each place where a document holds one is
a candidate: how many documents hold a seed decides nothing, so a leak is found in
the same way in one document and in a million. A candidate's window is aligned with the
item unless it cannot reach the score: an alignment matches at most the words of the
window that the item has, so a window with fewer than ``least`` of the item's words is
left out without loss. That ends most hits of common phrases. A document is
contaminated where the alignment reaches ``least`` of the item's full score, so edited,
shortened or interrupted copies count, too. One pass over the documents per block of
items of a bounded number of words; documents are never shuffled.

Cases: null or empty texts match nothing; an item with fewer words than the
n-gram is one seed as a whole, one without words is never found; repeated items
are each reported; rows with a null item or text are ignored; rows that share an
id are each judged; a run of words that is ``least`` of a short item counts however common it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import as_bytes, ngram_hashes, slices, words_of

N = 3
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.4
BLOCK_WORDS = 2_000_000
FILTER_BITS = 20


@dataclass
class Items:
    """A block of test items and their seeds, sorted by hash."""

    ids: list
    words: list[np.ndarray]
    seed: np.ndarray
    item: np.ndarray  # index of the seed's item
    offset: np.ndarray
    sizes: list[int]  # words of a seed: n, and smaller ones of shorter items

    @classmethod
    def of(cls, ids: list, texts: list[bytes], n: int = N) -> "Items":
        found = words_of(texts) if texts else None
        words = [found.hash[a:b] for a, b in zip(found.bounds[:-1], found.bounds[1:])] if texts else []
        seeds = [ngram_hashes(w, min(n, len(w))) if len(w) else w for w in words]
        item = np.repeat(np.arange(len(ids)), [len(s) for s in seeds]) if ids else np.zeros(0, int)
        offset = np.concatenate([np.arange(len(s)) for s in seeds]) if ids else item
        seed = np.concatenate(seeds) if ids else np.zeros(0, np.uint64)
        order = np.argsort(seed, kind="stable")
        return cls(ids, words, seed[order], item[order], offset[order], sorted({min(n, len(w)) for w in words if len(w)}))

    def hits(self, word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word position in the slice, position in ``seed`` of the first equal one) of each seed in the texts."""
        some = np.zeros(1 << FILTER_BITS, bool)
        shift = np.uint64(64 - FILTER_BITS)
        some[self.seed >> shift] = True
        texts, places, firsts = [], [], []
        for n in self.sizes:
            h = ngram_hashes(word, n)
            maybe = np.flatnonzero(some[h >> shift])
            at = np.searchsorted(self.seed, h[maybe])
            right = at < len(self.seed)
            right[right] = self.seed[at[right]] == h[maybe[right]]
            place, first = maybe[right], at[right]
            text = np.searchsorted(bounds, place, "right") - 1
            whole = place + n <= bounds[text + 1]  # runs never cross texts
            texts.append(text[whole])
            places.append(place[whole])
            firsts.append(first[whole])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, int)
        return join(texts), join(places), join(firsts)


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of an item against many padded windows (rows; 0 never matches): best scores and their end columns."""
    m = windows.shape[1]
    steps = np.arange(m + 1) * GAP
    row = np.zeros((len(windows), m + 1), np.int32)
    best, end = np.zeros(len(windows), np.int32), np.zeros(len(windows), np.int32)
    for word in item:
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(windows == word, MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new - steps, axis=1) + steps  # gaps along the window, at any length
        top = new.argmax(1)
        value = new[np.arange(len(new)), top]
        end = np.where(value > best, top, end)
        best = np.maximum(best, value)
        row = new
    return best, end


def find(items: Items, texts: list[bytes], least: float = LEAST, most_cells: int = 1 << 20) -> list[tuple]:
    """(text, item id, score, seeds, end word) for each text and item that align well enough."""
    best: dict[tuple[int, int], tuple] = {}
    sizes = np.array([len(w) for w in items.words])
    for a, b in slices(texts):
        words = words_of(texts[a:b])
        text, place, first = items.hits(words.hash, words.bounds)
        order = np.argsort(text, kind="stable")
        text, place, first = text[order], place[order], first[order]
        each = np.searchsorted(items.seed, items.seed[first], "right") - first
        # texts in groups of a bounded number of candidates, or one text
        cut = np.flatnonzero(np.diff(text, prepend=-1))
        for lo, hi in slices_of(np.add.reduceat(each, cut) if len(cut) else cut, most_cells):
            mine = slice(cut[lo], cut[hi] if hi < len(cut) else len(text))
            for row in _aligned(items, sizes, words, text[mine], place[mine], first[mine], each[mine], least, most_cells):
                row = (a + row[0], *row[1:])
                if row[:2] not in best or best[row[:2]][2] < row[2]:
                    best[row[:2]] = row
    return [(t, items.ids[i], s, c, e) for (t, i), (_, _, s, c, e) in sorted(best.items())]


def slices_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours that have at most ``most`` together, or one that has more."""
    total = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _aligned(items: Items, sizes: np.ndarray, words, text: np.ndarray, place: np.ndarray, first: np.ndarray, each: np.ndarray,
             least: float, most_cells: int) -> Iterator[tuple]:
    """(text, item, score, seeds, end word) of each window around seeds that aligns well enough."""
    seed = np.repeat(first, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    text, place = np.repeat(text, each), np.repeat(place, each)
    item, start = items.item[seed], place - items.offset[seed]
    # a window reaches half an item beyond where the item would lie; hits that expect almost the same place share one
    bin_ = (start - words.bounds[text]) // np.maximum(4, sizes[item] // 4)
    order = np.lexsort((bin_, text, item))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(item[order]) != 0) | (np.diff(text[order]) != 0) | (np.diff(bin_[order]) != 0)
    lead = np.flatnonzero(new)
    counts = np.diff(lead, append=len(order))
    lead = order[lead]  # the sort is stable: the first hit of each group
    cut = np.flatnonzero(np.diff(item[lead], prepend=-1))
    for lo, hi in zip(cut, [*cut[1:], len(lead)]):
        number = int(item[lead[lo]])
        word = items.words[number]
        own = np.unique(word)
        n = len(word)
        width = 2 * n + 4
        rows = max(1, most_cells // width)
        for k in range(lo, hi, rows):
            at = lead[k:min(hi, k + rows)]
            origin = start[at] - n // 2
            doc = text[at]
            columns = origin[:, None] + np.arange(width)
            inside = (columns >= words.bounds[doc][:, None]) & (columns < words.bounds[doc + 1][:, None])
            window = np.where(inside, words.hash[np.clip(columns, 0, len(words.hash) - 1)], np.uint64(0))
            held = own[np.minimum(np.searchsorted(own, window), len(own) - 1)] == window
            able = np.flatnonzero(np.minimum(held.sum(1), n) / n >= least)  # each match is one of these words
            score, end = align(word, window[able])
            share = score / (MATCH * n)
            for j in np.flatnonzero(share >= least):
                i = able[j]
                yield int(doc[i]), number, float(share[j]), int(counts[k + i]), int(origin[i] + end[j] - words.bounds[doc[i]])


def blocks(benchmark: DataFrame, n: int, most_words: int = BLOCK_WORDS) -> list[Items]:
    """The stated test set in blocks of bounded size, read one at a time."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id", "text")
    found, ids, texts, size = [], [], [], 0
    for row in rows.toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text.encode())
        size += len(row.text) // 4 + 1
        if size >= most_words:
            found.append(Items.of(ids, texts, n))
            ids, texts, size = [], [], 0
    return [*found, Items.of(ids, texts, n)] if ids else found


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N,
                 least: float = LEAST) -> DataFrame:
    """One row per document and test item found in it: id, item_id, score (1: the whole item), seeds, end_word."""
    docs = docs.select(F.col(id_col), F.col(text_col))
    id_type, item_type = docs.schema[0].dataType, benchmark.schema["item_id"].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("item_id", item_type), T.StructField("score", T.DoubleType()),
                           T.StructField("seeds", T.LongType()), T.StructField("end_word", T.LongType())])
    total = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, n):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # bounded

        def run(batches, shared=shared):
            for batch in batches:
                rows = find(shared.value, as_bytes(batch.column(1)), least)
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[k] for r in rows]) if rows else pa.array([], kind) for k, kind in (
                    (1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]], names=[f.name for f in schema])

        total = total.unionByName(docs.mapInArrow(run, schema))
    return total


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in which no test item is found; rows with a null id stay if their own text is clean."""
    bad = contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("_bad")).distinct()
    temp = docs.select(F.struct("*").alias("_doc"))
    return temp.join(bad, F.col(f"_doc.{id_col}").eqNullSafe(F.col("_bad")), "left_anti").select("_doc.*")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)
