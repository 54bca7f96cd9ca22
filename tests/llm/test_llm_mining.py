"""Collocations, whitening and sharding against plain Python on small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gondola.llm import phrases, sharding, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], DOCS)


# -- collocations

def plain_collocations(rows, least, top, percent=100):
    count, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    count[lang or "und"][tuple(words[i:i + k])] += 1
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            longer = [q for q in found if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if any(100 * found[q] >= percent * a for q in longer):
                continue
            cuts = [(1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def phrase_rows(seed):
    rng = random.Random(seed)
    words = ["the", "Cat", "of", "é", "日本", "x"] + [f"w{i}" for i in range(12)]
    fixed = ["new york city hall", "the\tcat  of", "a-b c_d", "x x x x x x"]
    rows = []
    for i in range(120):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 30))]
        rows.append((i, "".join(p + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\x0b", " "]) for p in parts), rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(500, None, "en"), (501, "", None), (None, "new york city hall", "en"), (7, "x x", "fr")] + [(9, "again and again", "en")] * 40


@pytest.mark.parametrize("chunk_bytes", (400, 1 << 20))
def test_collocations_against_all_ngrams(spark, chunk_bytes):
    rows = phrase_rows(4)
    got = phrases.collocations(documents(spark, rows), least=6, top=25, chunk_bytes=chunk_bytes)
    assert [f.name for f in got.schema] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 6, 25)


def test_colliding_fingerprints_do_not_change_counts(spark, monkeypatch):
    """With fingerprints of a few bits nearly all phrases collide; texts decide."""
    def few_bits(self, at, length, buckets):
        return phrases.span_hash(self.prefix, at, at + length) & phrases.U(31)

    rows = phrase_rows(5)
    table = pa.table({"lang": [r[2] for r in rows], "text": [r[1] for r in rows]})
    monkeypatch.setattr(phrases.ChunkWords, "keys", few_bits)
    words = phrases.ChunkWords(table)
    at = words.starts(1)
    ids = phrases.word_ids(words, at, words.keys(at, 1, 1))
    want = defaultdict(Counter)
    for i in range(1, 4):
        at = words.starts(i)
        got = Counter()
        for _, lang, phrase, n in phrases.materialised(words, at, words.keys(at, i, 1), i, ids):
            got[words.langs[lang], phrase.decode()] += n
        want = Counter()
        for _, text, lang in rows:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
                w = re.findall(r"[^\x20\x09]+", piece)
                want.update((lang or "und", " ".join(w[j:j + i])) for j in range(len(w) - i + 1))
        assert got == want


def test_score_beyond_64_bits():
    frame = "SELECT (CAST(1000 AS DECIMAL(4,0)) * CAST({a} AS DECIMAL(17,0)) * CAST({n} AS DECIMAL(17,0))) div (CAST({l} AS DECIMAL(18,0)) * CAST({r} AS DECIMAL(18,0))) AS s"
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    for a, n, left, right in ((10**12, 10**15, 10**13, 7 * 10**12), (10**16, 9 * 10**16, 3 * 10**16, 10**16 + 7)):
        assert spark.sql(frame.format(a=a, n=n, l=left, r=right)).first().s == 1000 * a * n // (left * right)


def test_saturated_counts_and_long_pieces(spark):
    assert phrases._unpacked(phrases._packed(np.array([1, 254, 255, 70000])), 4).tolist() == [1, 254, 255, 70000]
    text = b"ab " * 1000 + b"." + b"cd " * 700
    assert b"".join(phrases.parts_of(text, 50)) == text and len(list(phrases.parts_of(text, 50))) == 2
    rows = [(1, "p q " * 60000 + "." + "p q", "en"), (2, "p q", "en")]
    got = phrases.collocations(documents(spark, rows), least=300, top=9).collect()
    assert sorted(map(tuple, got)) == plain_collocations([(1, "p q " * 60000 + "." + "p q", "en"), (2, "p q", "en")], 300, 9)


def test_no_words_and_no_rows(spark):
    for rows in ([], [(1, None, None), (2, "", "en"), (3, ".,;", "en")]):
        assert phrases.collocations(documents(spark, rows)).count() == 0


def test_extra_columns_are_not_read(spark):
    docs = documents(spark, [(i, "new york", "en") for i in range(9)]).withColumns({n: F.lit("no") for n in ("phrase", "times", "a.b", "n", "chunk")})
    assert [r.phrase for r in phrases.collocations(docs, least=5).collect()] == ["new york"]


# -- whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def whole(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def test_whitening_against_exact_fractions(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6))
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(base)]
    rows += [(100 + i, rows[3][1], 1) for i in range(50)] + [(None, rows[4][1], 1), (3, rows[5][1], None)]
    bad = [(200, None, 0), (201, [], 0), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (203, [float("nan")] + [0.0] * 5, 0),
           (204, [float("-inf")] + [0.0] * 5, 0), (205, [1.0, 2.0], 0)]
    got = whitening.report(spark.createDataFrame(rows + bad, VECTORS)).collect()
    fit = sorted({tuple(whole(r[1])) for r in rows})
    n, dims = len(fit), 6
    sums = [sum(x[i] for x in fit) for i in range(dims)]
    cov = [[sum((x[i] - Fraction(sums[i], n)) * (x[j] - Fraction(sums[j], n)) for x in fit) / n for j in range(dims)] for i in range(dims)]
    values, vectors = np.linalg.eigh(np.array(cov, float))
    trace = float(sum(cov[i][i] for i in range(dims)))
    assert Counter((r.vec_id, r.component) for r in got) == Counter((r[0], c) for r in rows for c in range(1, dims + 1))
    by = defaultdict(list)
    for r in got:
        by[r.vec_id, r.component].append(r)
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained - values[::-1][r.component - 1] / trace) < 1e-12
    signs = np.zeros(dims)
    for i, vector, _ in rows:
        if i in (3, None):
            continue
        x = whole(vector)
        want = np.array([float(x[d] - Fraction(sums[d], n)) for d in range(dims)]) @ vectors[:, ::-1] / np.sqrt(values[::-1])
        for c in range(dims):
            r, = by[i, c + 1]
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums)) == int(r.deviation_digits)
            signs[c] = signs[c] or np.sign(want[c] * r.whitened)
            assert abs(r.whitened - signs[c] * want[c]) < 1e-9


def test_covariances_are_exact_for_wide_values():
    rng = random.Random(1)
    for spread in (5, 1 << 20, 1 << 40, 1 << 61):
        x = np.array([[rng.randint(-spread, spread) for _ in range(4)] for _ in range(25)])
        count, *sums = whitening.counted_sums(x)
        assert sums == [sum(int(v) for v in column) for column in x.T]
        center = np.array([s // count for s in sums])
        rest = [s - count * int(c) for s, c in zip(sums, center)]
        got = whitening.covariance(count, rest, whitening.squared(center)(x))
        ints = [[int(v) for v in row] for row in x]
        want = [[sum((count * r[i] - sums[i]) * (count * r[j] - sums[j]) for r in ints) // count for j in range(4)] for i in range(4)]
        assert got == want
        model = whitening.Model(count, sums, np.ones(4), np.eye(4), 1.0)
        assert model.deviation(x) == [sum((count * v - s) ** 2 for v, s in zip(r, sums)) for r in ints]


def test_whitening_edges(spark):
    none = whitening.report(spark.createDataFrame([(1, None, 0), (2, [], 0)], VECTORS))
    assert none.count() == 0 and none.columns[:4] == ["vec_id", "component", "n", "deviation"]
    same = whitening.report(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in same] == [(1, 0, None, 0.0)] * 4
    wide = whitening.report(spark.createDataFrame([(1, [3e38, 2.0], 0), (2, [1.0, -2.0], 0), (3, [0.0, 1.0], 0)], VECTORS)).collect()
    assert {r.deviation for r in wide if r.vec_id == 1} == {None} and all(len(r.deviation_digits) > 30 for r in wide if r.vec_id == 1)
    clash = spark.createDataFrame([(i, [float(i), float(i * i)], 0) for i in range(9)], VECTORS).withColumns({c: F.lit("no") for c in ("x", "n", "id", "a.b")})
    assert whitening.report(clash).count() == 18


# -- sharding

def test_hypergeometric_draws_follow_their_law(spark):
    for total, good, drawn in ((1, 1, 1), (7, 3, 2), (20, 1, 10), (50, 25, 20), (400, 30, 390), (5000, 2500, 60), (10**6, 62500, 65536)):
        rows = spark.range(4000).select(sharding.hypergeometric(
            F.lit(total).cast("bigint"), F.lit(good).cast("bigint"), F.lit(drawn).cast("bigint"), F.col("id"), 5).alias("k"))
        got = Counter(r.k for r in rows.collect())
        low, high = max(0, drawn - (total - good)), min(good, drawn)
        logs = {k: -sum(math.lgamma(v + 1) for v in (k, good - k, drawn - k, total - good - drawn + k)) for k in range(low, high + 1)}
        top = max(logs.values())
        weight = {k: math.exp(v - top) for k, v in logs.items()}
        law = {k: w / sum(weight.values()) for k, w in weight.items()}
        assert set(got) <= set(law)
        mean = sum(k * p for k, p in law.items())
        deviation = math.sqrt(sum((k - mean) ** 2 * p for k, p in law.items()))
        assert abs(sum(k * n for k, n in got.items()) / 4000 - mean) <= 4 * deviation / math.sqrt(4000) + 1e-9
        seen = below = 0.0
        for k in sorted(law):  # largest gap of the distribution functions
            seen, below = seen + got[k] / 4000, below + law[k]
            assert abs(seen - below) < 0.035


def test_the_box_holds_the_whole_law():
    """Ratio of uniforms needs |k - mean| times the root of the probability over the mode's within half the width."""
    rng = random.Random(8)
    for _ in range(300):
        total = rng.choice((2, 5, 30, 1000, 50000))
        good, drawn = rng.randint(1, total - 1), rng.randint(1, total - 1)
        low, high = max(0, drawn - (total - good)), min(good, drawn)
        share = good / total
        variance = drawn * share * (1 - share) * (total - drawn) / (total - 1)
        half, center = (1.7155277699214135 * math.sqrt(variance + 0.5) + 0.8989161620588988) / 2, drawn * share + 0.5
        mode = (drawn + 1) * (good + 1) // (total + 2)
        log = lambda k: -sum(math.lgamma(v + 1) for v in (k, good - k, drawn - k, total - good - drawn + k))
        for k in range(max(low, mode - 3000), min(high, mode + 3000) + 1):
            assert max(abs(k - center), abs(k + 1 - center)) * math.exp((log(k) - log(mode)) / 2) <= half + 1e-9


def test_matrix_has_exact_sums_at_any_depth(spark):
    rng = random.Random(3)
    sizes = [rng.choice((1, 2, 50, 700)) for _ in range(60)]
    pieces = spark.createDataFrame(list(enumerate(sizes)), "unit long, n long")
    for group in (4, 16, 128):
        got = {r.unit: r.counts for r in sharding.communication_matrix(pieces, 5, seed=group, group=group).collect()}
        assert [sum(got[i]) for i in range(60)] == sizes
        total = sum(sizes)
        assert [sum(c[j] for c in got.values()) for j in range(5)] == [total // 5 + (j < total % 5) for j in range(5)]
        assert all(min(c) >= 0 for c in got.values())


def test_shards_are_whole_exact_and_repeatable(spark, tmp_path):
    rows = [(i if i % 9 else None, None if i % 7 == 0 else "copy" if i % 3 else f"text {i} é", "en") for i in range(997)]
    docs = documents(spark, rows).repartition(6).withColumns({c: F.lit(1) for c in ("shard", "slot", "a.b", "size", "doc")})
    placed = sharding.shuffle_into_shards(docs, 16, piece_bits=5, part_rows=20)
    got = placed.collect()
    assert Counter((r.doc.doc_id, r.doc.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert {len(v) for v in slots.values()} == {997 // 16, 997 // 16 + 1}
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert Counter(placed.collect()) == Counter(got)
    name = sharding.write_shards(docs.drop("a.b"), str(tmp_path / "out"), 4)
    assert name == "_shard" and spark.read.parquet(str(tmp_path / "out")).groupBy(name).count().count() == 4


def test_places_are_uniform(spark):
    """Neighbours of the input end in independent shards, and every place is as likely."""
    docs = spark.range(6000).repartitionByRange(5, "id")
    together = first = 0
    for seed in range(3):
        at = {r.doc.id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(docs, 10, seed, piece_bits=8, part_rows=100).collect()}
        together += sum(at[i][0] == at[i + 1][0] for i in range(5999))
        first += sum(at[i][1] < 300 for i in range(3000))
    assert abs(together / (3 * 5999) - 0.1) < 0.01
    assert abs(first / 9000 - 0.5) < 0.03


def test_report_and_few_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (None, "é", None)]
    got = {r.doc_id: r for r in sharding.report(documents(spark, rows)).collect()}
    assert (got[1].size, got[1].text_crc32, got[2].size) == (1, 0, 1)
    assert (got[None].size, got[None].text_crc32) == (3, zlib.crc32("é".encode()))
    assert sorted((r.shard, r.slot, r.law, r.grown_shard) for r in got.values()) == [(i, 0, "rows", None) for i in range(3)]
    assert sharding.report(documents(spark, [])).count() == 0
