"""Near-duplicates by SetSketch: registers, bands, likelihood, verification, components.

A document's set of word shingles fills ``M`` registers with truncated,
exponentially spaced minima. Equal sets form classes at once (a group of exact
copies is one row from there on). Classes that agree in all registers of a band
meet in a bucket. Buckets never emit all pairs: each member is paired with the
bucket's least member only. Pairs pass a size bound, a 128-bit test and the joint
likelihood of their registers, and are confirmed on the full sets.

Where these links leave a bucket with several components, members outside the
leader's component may still be linked with others. They and the component's
members in such buckets form an arena, cut into blocks of ``BLOCK`` documents;
each pair of blocks is one small task that compares registers first and full sets
then, as matrices, and emits only the links it confirms.

Cases: documents without words are linked with nothing; fewer words than a
shingle are one shingle; rows with a null id have no component and are kept;
rows that share an id share its component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stored
from .text import as_bytes, mixed, ngram_hashes, slices, words_of

BANDS, ROWS = 36, 6
M = BANDS * ROWS
BASE, RATE, TOP = 1.001, 100.0, 65535
BLOCK = 512
LEAST_PERCENT = 80  # below, pairs often share no band

_u = np.arange(1, M + 1, dtype=np.uint64)
MULTIPLIERS = mixed(_u * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
OFFSETS = mixed(_u * np.uint64(0xE7037ED1A0B428DB))


def likely(percent: int) -> float:
    """Estimates below this are taken as unlinked: a pair at the threshold falls there once in 100,000 times (0.68 at 80)."""
    j = percent / 100
    return j - 4.4 * (j * (1 - j) / M) ** 0.5 - 1e-4  # the search for the estimate stops that close


def bits_off(percent: int) -> int:
    """How many of 128 register bits may differ: the mean at the threshold and 4.8 deviations (29 at 80)."""
    p = (1 - percent / 100) / 2
    return int(128 * p + 4.8 * (128 * p * (1 - p)) ** 0.5)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = words_of(texts)
    sets = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        sets.append(np.unique(ngram_hashes(words.hash[a:b], min(width, b - a))) if b > a else np.zeros(0, np.uint64))
    return sets


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, M) SetSketch registers; the minimum of a set's exponential values, in steps of the base's logarithm."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out = np.zeros((len(sets), M), np.uint16)
    if not full:
        return out
    every = np.concatenate([sets[i] for i in full])
    starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    for k in range(M):
        least = np.minimum.reduceat(every * MULTIPLIERS[k] + OFFSETS[k], starts)
        x = -np.log1p(-(least.astype(float) + 1) / 2.0 ** 64 * (1 - 2.0 ** -52))
        out[full, k] = np.clip(np.floor(1 - np.log(x / RATE) / np.log(BASE)), 0, TOP)
    return out


def likelihood(same: np.ndarray, more: np.ndarray, less: np.ndarray, n: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Similarity that makes the numbers of equal, greater and smaller registers likeliest, given both set sizes."""
    u = n / (n + other)
    v = 1 - u
    step = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def logs(j: np.ndarray) -> np.ndarray:
        up, down = np.maximum(step(u - v * j), 1e-12), np.maximum(step(v - u * j), 1e-12)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # concave in j
        one, two = low + (high - low) / 3, high - (high - low) / 3
        better = logs(one) < logs(two)
        low, high = np.where(better, one, low), np.where(better, high, two)
    return (low + high) / 2


SKETCH = "id bigint, n bigint, set_a bigint, set_b bigint, bits_a bigint, bits_b bigint, regs binary"


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """One row per document (id, text): set size, 128-bit set identity and registers."""
    band = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], width)
                regs = registers(sets)
                odd = np.packbits((mixed(regs[:, :128].astype(np.uint64) + band[:1]) >> np.uint64(63)).astype(np.uint8), axis=1).view(np.int64)
                one = np.array([s.sum() for s in map(mixed, sets)], np.uint64).view(np.int64)
                two = np.array([mixed(s ^ np.uint64(0x5555)).sum() for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(one),
                     pa.array(two), pa.array(odd[:, 0].copy()), pa.array(odd[:, 1].copy()), pa.array([r.tobytes() for r in regs], pa.binary())],
                    names=["id", "n", "set_a", "set_b", "bits_a", "bits_b", "regs"])

    return docs.mapInArrow(run, SKETCH)


def band_keys(reps: DataFrame) -> DataFrame:
    """(id, key): a hash of the registers of each band; keys of different bands differ."""
    band = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, M)
                keys = np.repeat(band[None], len(regs), 0)
                for k in range(ROWS):
                    keys = mixed(keys + regs[:, k::ROWS].astype(np.uint64))
                each = pa.array(np.repeat(np.arange(len(regs)), BANDS))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(each), pa.array(keys.ravel().view(np.int64))], names=["id", "key"])

    return reps.select("id", "regs").mapInArrow(run, "id bigint, key bigint")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose registers estimate a similarity near the threshold or above."""
    least = likely(percent)
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))

    def run(batches):
        for batch in batches:
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M).astype(np.int32) for c in ("regs_a", "regs_b")]
            n, other = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            same, more = (regs[0] == regs[1]).sum(1), (regs[0] > regs[1]).sum(1)
            j = likelihood(same, more, M - same - more, n, other) if len(n) else np.zeros(0)
            yield batch.select(["a", "b"]).filter(pa.array(j >= least))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a bigint, b bigint")


def _possible(a: str, b: str, percent: int):
    """The bounds that need no register: set sizes and a bit of each of 128 registers."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    off = F.bit_count(F.col(f"{a}.bits_a").bitwiseXOR(F.col(f"{b}.bits_a"))) + F.bit_count(F.col(f"{a}.bits_b").bitwiseXOR(F.col(f"{b}.bits_b")))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (off <= bits_off(percent))


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ids whose full sets reach the similarity."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.join(ids, "id", "left_semi")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            one, two = as_bytes(batch.column(2)), as_bytes(batch.column(3))
            right = np.zeros(len(one), bool)
            last: tuple[bytes, np.ndarray] | None = None
            for i in range(len(one)):
                if last is None or last[0] != one[i]:
                    last = one[i], shingle_sets([one[i]], width)[0]
                other = shingle_sets([two[i]], width)[0]
                common = len(np.intersect1d(last[1], other, assume_unique=True))
                right[i] = 100 * common >= percent * (len(last[1]) + len(other) - common)
            yield batch.select(["a", "b"]).filter(pa.array(right))

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def _duels(members: DataFrame, columns: list[str]) -> DataFrame:
    """Arena members (arena, id, group, ...) sent to each pair of blocks (p <= q) that includes theirs, and sorted by it."""
    sizes = members.groupBy("arena").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "arena").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("arena", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "group", *columns)
    return sent.repartition("arena", "p", "q").sortWithinPartitions("arena", "p", "q", "block", "id")


def _runs(batches):
    """Arrow tables of one (arena, p, q) each, out of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("arena", "p", "q")], 1)
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
        for a, b in zip(cut[:-1], cut[1:]):
            if b > a:
                if held and (key[a] != last).any():
                    yield pa.Table.from_batches(held)
                    held = []
                last = key[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _sides(run: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the first block, rows each of them is compared with, and all groups."""
    block = run["block"].to_numpy()
    every = np.arange(len(block))
    p, q = run["p"][0].as_py(), run["q"][0].as_py()
    return (every, every, run["group"].to_numpy()) if p == q else (every[block == p], every[block == q], run["group"].to_numpy())


def _promising(members: DataFrame, percent: int) -> DataFrame:
    """(arena, id) of members whose registers suggest a link to another component's member in their arena."""
    least = likely(percent)
    few = (least - 0.08) * M

    def run(batches):
        for table in _runs(batches):
            one, two, group = _sides(table)
            regs = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint16).reshape(-1, M)
            n, ids = table["n"].to_numpy().astype(float), table["id"].to_numpy()
            found = set()
            for i in one:
                others = two[(group[two] != group[i]) & (two != i)]
                others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
                same = (regs[others] == regs[i]).sum(1)
                others, same = others[same >= few], same[same >= few]
                if len(others):
                    more = (regs[others] < regs[i]).sum(1)
                    near = others[likelihood(same, more, M - same - more, np.full(len(others), n[i]), n[others]) >= least]
                    found.update(ids[near].tolist(), ids[[i]].tolist() if len(near) else ())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([table["arena"][0].as_py()] * len(found), pa.int64()), pa.array(sorted(found), pa.int64())],
                                                 names=["arena", "id"])

    return _duels(members, ["n", "regs"]).mapInArrow(run, "arena bigint, id bigint").distinct()


def _confirmed(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components inside arenas, on full sets; one per two components and pair of blocks is enough."""
    def run(batches):
        for table in _runs(batches):
            one, two, group = _sides(table)
            ids = table["id"].to_numpy()
            texts = as_bytes(table["text"].combine_chunks())
            sets = [s for a, b in slices(texts) for s in shingle_sets(texts[a:b], width)]
            size = np.array([len(s) for s in sets])
            every, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            column = np.cumsum(count > 1) - 1  # shingles of one document are in no intersection
            owner = np.repeat(np.arange(len(sets)), size)
            bits = np.zeros((len(sets), int((count > 1).sum()) // 8 + 1), np.uint8)
            shared = count[where] > 1
            at = column[where[shared]]
            np.bitwise_or.at(bits, (owner[shared], at // 8), (1 << (at % 8)).astype(np.uint8))
            a, b, done = [], [], set()
            for i in one:
                others = two[(group[two] != group[i]) & (two != i)]
                common = np.bitwise_count(bits[others] & bits[i]).sum(1, dtype=np.int64)
                for j in others[100 * common >= percent * (size[others] + size[i] - common)]:
                    pair = (min(group[i], group[j]), max(group[i], group[j]))
                    if pair not in done:
                        done.add(pair)
                        a.append(int(ids[i]))
                        b.append(int(ids[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _duels(members, ["text"]).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n, component) of every row: set size and least id of its group of near-duplicates; ``percent`` from 80."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 100")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    drawn = stored(sketches(texts, width), "sketches")
    sets = drawn.where("n > 0 AND id IS NOT NULL")
    classes = stored(sets.groupBy("set_a", "set_b", "n").agg(F.min("id").alias("rep")), "classes")
    reps = sets.join(classes.select(F.col("rep").alias("id"), "set_a", "set_b", "n"), ["id", "set_a", "set_b", "n"], "left_semi")
    # read many times below: each would bring all registers through two shuffles again
    reps = stored(reps.dropDuplicates(["id", "set_a", "set_b"]), "reps")
    keyed = band_keys(reps)
    leaders = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last").drop("last")
    buckets = stored(keyed.join(leaders, "key"), "buckets")
    brief = reps.select("id", "n", "bits_a", "bits_b")

    star = buckets.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    star = star.join(brief.alias("x"), F.col("a") == F.col("x.id")).join(brief.alias("y"), F.col("b") == F.col("y.id")).where(
        _possible("x", "y", percent)).select("a", "b")
    rep_texts = texts.where("id IS NOT NULL")
    links = stored(verified(_likely(star, reps, percent), rep_texts, width, percent), "links")
    groups = components(links)

    # Members outside their leader's component can still be linked with one another or with members that are inside.
    of = lambda c: groups.select(F.col("id").alias(c), F.col("component").alias(f"{c}_group"))
    placed = buckets.join(of("id"), "id", "left").join(of("leader"), "leader", "left").select(
        "key", "id", "leader", F.coalesce("id_group", "id").alias("group"), F.coalesce("leader_group", "leader").alias("lead"))
    placed = stored(placed.where("id <> leader"), "placed")
    outside = placed.where("group <> lead")
    inside = placed.where("group = lead").join(outside.select("key").distinct(), "key", "left_semi")
    arenas = stored(outside.unionAll(inside).select(F.col("lead").alias("arena"), "id", "group").distinct(), "arenas")
    promising = stored(_promising(arenas.join(reps.select("id", "n", "regs"), "id"), percent), "promising")
    if not promising.isEmpty():
        ids = promising.select("id").distinct()
        chosen = rep_texts.join(ids, "id", "left_semi").join(arenas.join(promising, ["arena", "id"]), "id")
        more = stored(_confirmed(chosen, width, percent), "more")
        if not more.isEmpty():
            groups = components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more))

    named = classes.join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "set_a", "set_b", "n", F.coalesce("component", "rep").alias("component"))
    return drawn.select("id", "n", "set_a", "set_b").join(named, ["set_a", "set_b", "n"], "left").select(
        "id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The least document of each group; rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, width, percent)
    gone = found.where("id <> component").select(F.col("id").alias("_gone")).distinct()
    return docs.select(F.struct("*").alias("_doc")).join(gone, F.col(f"_doc.{id_col}") == F.col("_gone"), "left_anti").select("_doc.*")


def report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs.select("doc_id", "text"), width=2)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                      ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2),
links AS (SELECT p, q FROM pairs WHERE 100 * c >= 80 * (n + m - c)),
sym AS (SELECT p, q FROM links UNION ALL SELECT q, p FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, sym.q FROM reach r JOIN sym ON sym.p = r.other)
SELECT doc_id, len(s)::bigint AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM sets JOIN reach USING (doc_id) GROUP BY doc_id, s"""
