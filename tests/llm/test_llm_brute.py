"""Operators that SQL cannot state, against plain Python on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gondola.llm import decontam, langid, lines, mixing, neardup, pii, ppm, prefixhash, suffix, toxicity
from gondola.llm.queries import SETTINGS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], SCHEMA)


def sentences(rng, n, words="the cat of and a dog ran over hill under moon with red green lamp".split()):
    return [" ".join(rng.choice(words) for _ in range(rng.randint(3, 9))) + "." for _ in range(n)]


# -- repeated substrings

def test_suffix_dedup_against_all_strings(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(50)) for _ in range(5)]
    docs = []
    for i in range(50):
        parts = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            s = rng.randint(0, len(b) - 1)
            parts += [b[s:s + rng.randint(20, 120)], "x" * rng.choice((0, 0, 7, 90)), word()]
        docs.append((i, "".join(parts)))
    docs += [(90, None), (91, ""), (92, docs[1][1]), (93, docs[1][1]), (None, docs[1][1] + base[0])]
    got = {r.id: r for r in suffix.remove_repeats(table(spark, docs), chunk_bytes=1500).collect()}
    first = {}
    for i, t in docs:
        data = (t or "").encode()
        if i is not None:
            for p in range(len(data) - 49):
                first.setdefault(data[p:p + 50], i)
    for i, t in docs:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        if i is not None:
            for p in range(len(data) - 49):
                if first[data[p:p + 50]] < i:
                    gone[p:p + 50] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, bytes(got[i].kept)) == (len(data), int(gone.sum()), kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert got[i].n_spans == int((np.diff(gone.astype(int), prepend=0) == 1).sum())


@pytest.mark.parametrize("many", (0, 3, 40))
def test_hot_passages_with_own_ends(spark, many):
    rng = random.Random(many)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot, tail = own(130), own(60)
    docs = [(i, own(rng.randint(0, 60)) + hot[rng.choice((0, 0, 1, 9)):] + rng.choice(["", tail, own(40)])) for i in range(80)]
    docs += [(i, hot + hot[:rng.randint(40, 130)] + rng.choice(["", tail])) for i in range(80, 100)] + [(None, hot), (5, hot + tail)]
    rng.shuffle(docs)
    first = {}
    for i, t in docs:
        for p in range(len(t) - 49) if i is not None else ():
            first[t[p:p + 50]] = min(i, first.get(t[p:p + 50], i))
    want = Counter()
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49) if i is not None else ():
            if first[t[p:p + 50]] < i:
                gone[p:p + 50] = True
        want[i, hashlib.sha256(np.frombuffer(t.encode(), np.uint8)[~gone].tobytes()).hexdigest()] += 1
    rows = suffix.remove_repeats(table(spark, docs), chunk_bytes=2000, many=many).collect()
    assert Counter((r.id, r.kept_sha256) for r in rows) == want


def test_no_bucket_follows_a_hot_passage():
    import pyarrow as pa

    rng = random.Random(1)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    hot = own(200)
    chunk = suffix.Chunk(pa.table({"id": list(range(20_000)), "text": [own(50) + hot + own(50) for _ in range(20_000)], "chunk": [0] * 20_000}), 256)
    most = lambda rows: max(Counter({b: sum(len(r.data) + len(r.more) + len(r.last) for r in rows if r.bucket == b) for b in {r.bucket for r in rows}}).values())
    chunk.grams()
    told = lambda work, rows: [a for b in sorted({r.bucket for r in rows}) for a in work([r for r in rows if r.bucket == b])]
    chunk.entries(told(suffix.shared_grams, chunk.ask_grams()))
    assert most(chunk.ask_segments()) < 100_000  # different ends, of 20 bytes each, are dealt out
    chunk.odd(told(suffix.least_documents, chunk.ask_segments()))
    assert most(chunk.ask_windows()) < 400_000  # as text, of 92 bytes each, at most MANY of one q-gram


def test_bucket_pointers_order_strings():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    data[100:180] = data[200:280]
    bucket = suffix.refined_buckets(data)
    text = data.tobytes()
    starts = range(0, len(text) - 50)
    for p in list(starts)[::7]:
        for q in list(starts)[::5]:
            assert (bucket[p] == bucket[q]) == (text[p:p + 50] == text[q:q + 50])
            assert (bucket[p] < bucket[q]) == (text[p:p + 50] < text[q:q + 50])


# -- language model

def test_ppm_against_a_trie_of_counters(spark):
    rng = random.Random(5)
    docs = [(i, None if i == 7 else "" if i == 8 else "\n".join(sentences(rng, 3)) + rng.choice(["", "ÉÑ", "Zq"])) for i in range(40)]
    order, edge = ppm.ORDER, 0
    symbols = lambda t: [edge] * order + [b + 1 for b in (t or "").encode().lower()] + [edge]
    counts, tokens = defaultdict(Counter), Counter()
    for i, t in docs:
        if not ppm.is_held_out(i):
            x = symbols(t)
            for p in range(order, len(x)):
                for k in range(order + 1):
                    counts[tuple(x[p - k:p])][x[p]] += 1
            tokens.update((t or "").encode().lower().split() + [b""])

    def log(context, symbol):
        gone, total = set(), 0.0
        for k in range(order, -1, -1):
            seen = {s: c for s, c in counts.get(tuple(context[order - k:]), {}).items() if s not in gone}
            if seen:
                n = 2 * sum(seen.values())
                if symbol in seen:
                    return total + math.log10((2 * seen[symbol] - 1) / n)
                total += math.log10(len(seen) / n)
                gone |= set(seen)
        return total - math.log10(257 - len(gone))

    assert sum(10 ** log(symbols("the")[3:8], s) for s in range(257)) == pytest.approx(1)
    n, v = sum(tokens.values()), len(tokens)
    got = {r.id: r for r in ppm.score(table(spark, docs), chunk_bytes=900).collect()}
    assert {r.held_out for r in got.values()} == {True, False}
    for i, t in docs:
        x, words = symbols(t), (t or "").encode().lower().split() + [b""]
        want = sum(log(x[p - order:p], x[p]) for p in range(order, len(x)))
        assert got[i].score == pytest.approx(want, rel=1e-5)
        assert got[i].base_score == pytest.approx(sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words), sum(tokens[w] > 0 for w in words), n)


# -- benchmark decontamination

def test_decontamination_finds_copies_and_edits_only(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, prose(30)) for k in range(20)]
    docs, leaked = [], set()
    for i in range(200):
        body = prose(rng.randint(5, 200))
        if i % 4 == 0:
            k = rng.randrange(20)
            copy = [rng.choice(words) if i % 8 == 0 and rng.random() < 0.15 else w.upper() for w in items[k][1]]
            body = [*body, *copy, *prose(rng.randint(0, 60))]
            leaked.add((i, k))
        docs.append((i, " ".join(body)))
    docs += [(500, None), (501, ""), (502, " ".join(items[3][1][:8])), (503, "hot " + " ".join(items[5][1]))]
    leaked.add((503, 5))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(90, None), (91, ""), (92, "zzz yyy")], "item_id long, text string")
    rows = decontam.contaminated(table(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == leaked
    kept = {r.doc_id for r in decontam.drop_contaminated(table(spark, docs), bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in leaked}
    empty = bench.limit(0)
    assert decontam.contaminated(table(spark, docs), empty).count() == 0
    assert decontam.contaminated(table(spark, []), bench).count() == 0


@pytest.mark.parametrize("kind", ("edited", "half"))
@pytest.mark.parametrize("copies", (5, 11, 1000))
def test_partial_leaks_are_found_in_any_number_of_documents(spark, copies, kind):
    rng = random.Random(copies)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(900)]
    item = rng.sample(words, 60)
    other = [w for w in words if w not in item]
    edited = [rng.choice(other) if k % 5 == 2 else w for k, w in enumerate(item)]
    docs = []
    for i in range(copies):
        for leak in (edited if kind == "edited" else item[:27],):
            docs.append((len(docs), " ".join([*rng.choices(other, k=20), *leak, *rng.choices(other, k=20)])))
    docs += [(10_000 + i, " ".join([*rng.choices(other, k=30), *item[:3], *rng.choices(other, k=30)])) for i in range(3)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(table(spark, docs), bench).collect()} == set(range(copies))


def test_alignment_equals_plain_smith_waterman():
    rng = random.Random(2)
    for _ in range(30):
        a, b = [[rng.randint(1, 4) for _ in range(rng.randint(1, 12))] for _ in range(2)]
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        got, _ = decontam.align(np.array(a, np.uint64), np.array([b], np.uint64))
        assert got[0] == max(map(max, h))


# -- near-duplicates

def test_sketch_likelihood_estimates_similarity():
    rng = np.random.default_rng(4)
    every = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for same in (300, 1200, 2000, 2700):
        one, two = every[:2000 + 0 * same], np.concatenate([every[:same // 2], every[2000:]])
        true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        regs = neardup.registers([np.unique(one), np.unique(two)]).astype(int)
        both = neardup.registers([np.union1d(one, two)]).astype(int)
        assert (np.maximum(regs[0], regs[1]) == both[0]).all()  # mergeable
        d = [np.array([float(x)]) for x in ((regs[0] == regs[1]).sum(), (regs[0] > regs[1]).sum(), (regs[0] < regs[1]).sum())]
        j = neardup.likelihood(*d, np.array([float(len(one))]), np.array([float(len(two))]))[0]
        assert abs(j - true) < 0.12


@pytest.mark.parametrize("width, block", ((2, 512), (5, 512), (2, 5)))
def test_near_duplicates_equal_all_pairs(spark, width, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    docs = []
    for g in range(12 if block > 5 else 4):
        base = [rng.choice(words) for _ in range(rng.randint(1, 80) if block > 5 else 70)]
        for _ in range(rng.randint(1, 12) if block > 5 else 40):
            body = list(base)
            for _ in range(rng.randint(0, 3 if block > 5 else 5)):
                body[rng.randrange(len(body))] = rng.choice(words)
            docs.append((len(docs) * 3, " ".join(body)))
    docs += [(1000, None), (1001, ""), (1002, " \t"), (1003, "one"), (1004, "ONE"), (None, docs[0][1])]
    rng.shuffle(docs)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()

    sets = {i: shingles(t) for i, t in docs if i is not None}
    root = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = {r.id: r for r in neardup.near_duplicates(table(spark, docs), width=width).collect()}
    assert {i: got[i].component for i in ids} == root
    assert all(got[i].n == len(sets[i]) for i in ids)
    assert got[None].component is None
    kept = {r.doc_id for r in neardup.drop_near_duplicates(table(spark, docs), width=width).collect()}
    assert kept == {i for i in ids if root[i] == i} | {None}


def test_long_chain_is_one_component(spark):
    from gondola.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 201), (5, 5)], "a long, b long")
    assert {(r.id, r.component) for r in components(links).collect()} == {(i, 0) for i in range(1, 61)} | {(201, 200)}


# -- toxicity and language

def test_toxicity_learns_from_document_labels(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(900):
        said, toxic = sentences(rng, rng.randint(1, 8)), int(i % 3 == 0)
        if toxic:
            said.insert(rng.randrange(len(said) + 1), f"you {rng.choice(['grobnik', 'zluk'])} of the hill.")
        docs.append((i, " ".join(said)))
        labels.append((i, 1, toxic))
    docs += [(5000, None), (5001, "")]
    lab = spark.createDataFrame(labels + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.report(table(spark, docs), lab).collect()
    got = {r.doc_id: r for r in rows}
    test = [i for i in range(900) if got[i].held_out]
    assert len(test) > 100 and sum(got[i].predicted == int(i % 3 == 0) for i in test) / len(test) > 0.97
    found = [r for r in rows if r.worst_sentence]
    assert sum(("grobnik" in r.worst_sentence) or ("zluk" in r.worst_sentence) for r in found) / len(found) > 0.97
    assert got[5000].predicted == got[5001].predicted == 0
    none = toxicity.report(table(spark, docs[:5]), lab.limit(0)).collect()
    assert max(r.score for r in none) < 1e-9


def test_length_alone_is_not_toxic():
    rng = random.Random(10)
    texts, labels = [], []
    for i in range(1500):
        said, toxic = sentences(rng, rng.randint(1, 8)), int(i % 3 == 0)
        if toxic:
            said.insert(rng.randrange(len(said) + 1), "you grobnik of the hill.")
        texts.append(" ".join(said).encode())
        labels.append(toxic)
    model = toxicity.train(texts, np.array(labels))
    assert model.bias != -9.0 and model.leak != 1e-3  # learned
    unknown = [f"entry{k} zz{k % 977}" for k in range(50_000)]
    known_words = sentences(rng, 50_000)
    hidden = [*unknown[:30_000], "you grobnik of the hill.", *unknown[30_000:]]
    scores, worst, _ = toxicity.score_texts(model, ["\n".join(lines_).encode() for lines_ in (unknown, known_words, hidden)] + [b""])
    assert max(scores[0], scores[1], scores[3]) < 0.5 <= scores[2]  # one toxic sentence still counts in a long text
    assert b"grobnik" in worst[2]
    features = np.zeros(0, np.uint64)
    most = toxicity.Model(features, np.zeros(1), toxicity.MOST_BIAS, toxicity.MOST_LEAK)
    assert toxicity.score_texts(most, [b"a\n" * 2_000_000])[0][0] < 0.5


def test_language_network(spark):
    rng = random.Random(6)
    parts = {"xx": ["ka", "to", "mi", "ru"], "yy": ["sch", "eng", "ber", "ü"], "zz": ["ció", "que", "los", "ña"]}
    docs = []
    for i in range(240):
        lang = "xyz"[i % 3] * 2
        docs.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))),
                     lang if i % 10 else None, "s", None))
    docs += [(900, None, "xx", "s", 0), (901, "12 34 !?", "xx", "s", 0), (902, "", None, "s", 0)]
    got = {r.doc_id: r for r in langid.report(spark.createDataFrame(docs, SCHEMA)).collect()}
    test = [i for i in range(240) if got[i].held_out]
    assert sum(got[i].lang_pred == "xyz"[i % 3] * 2 for i in test) / len(test) > 0.95
    assert {(got[i].lang_pred, got[i].score) for i in (900, 901, 902)} == {("und", 0.0)}
    assert {r.lang_pred for r in langid.report(table(spark, []).unionAll(table(spark, [(0, "abc")])).withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}


def test_convolution_gradients():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 110, 150).astype(np.uint8)) for _ in range(4)]
    net = langid.train(texts, ["a", "b", "a", "b"], epochs=0)
    net.embed = net.embed.astype(float)
    net.filters = [f.astype(float) for f in net.filters]
    codes, owner, _ = langid.windows_of(texts)
    target, weight = owner % 2, np.ones(len(owner))
    loss = lambda: -langid.log_probs(net, codes)[np.arange(len(codes)), target].mean()
    for param, grad in zip([net.embed, *net.filters, net.shift, net.out, net.bias], langid._gradients(net, codes, target, weight)):
        flat = [tuple(rng.integers(0, n) for n in param.shape) for _ in range(6)]
        if param is net.embed:
            flat = [(100, 2), (105, 0)]
        for at in flat:
            old, step = param[at], 1e-3
            param[at] = old + step
            up = loss()
            param[at] = old - step
            down = loss()
            param[at] = old
            assert grad[at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


# -- fingerprints

def test_fingerprints_and_edited_texts(spark):
    rng = random.Random(4)
    docs = [(i * 2, " ".join(sentences(rng, rng.randint(1, 30))) + rng.choice(["", "é", "日本"])) for i in range(60)]
    docs += [(7, docs[3][1]), (9, None), (11, ""), (13, "ab"), (15, docs[3][1])]
    shuffled = rng.sample(docs, len(docs))
    rows = prefixhash.report(table(spark, shuffled).repartition(5)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    ordered = sorted((i, t or "") for i, t in docs)
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        new = t[:len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (t == new)
        a, b = t.encode(), new.encode()
        common = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert got[i].common_prefix == common
        if len(t) > 300 and t != after:
            assert got[i].near_edited > got[i].near_next
    assert got[6].fingerprint == got[7].fingerprint == got[15].fingerprint
    assert got[9].fingerprint == got[11].fingerprint
    alone = prefixhash.report(table(spark, [(1, "abc")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert prefixhash.report(table(spark, [])).count() == 0


# -- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_equals_plain_regular_expressions(spark):
    rng = random.Random(12)
    bits = ["a.b@c.de", "x@y", "@", "a@b.c_d@e.f.g", "z%+@q-.r.", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "0000255.1.1.01", "4532 0151 1283 0366",
            "4532015112830366", "4532015112830367", "+1 (269) 555-3296", "+1", "+12345678", "+44 20.7946-0958 (", "é日", " ", "-", "7", "GB82WEST12345698765432",
            "GB82WEST12345698765431", "99999999999999999999999.1.1.1", "word", "\n", "+", "."]
    docs = [(i, "".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "1 " * 30000 + "@"), (903, "a" * 50000 + "@b.c " + "5" * 30000), (904, "." * 30000 + "+1" + "(" * 30000)]
    from pyspark.sql import functions as F
    got = {r.doc_id: r for r in pii.report(table(spark, docs).withColumn("spans", F.lit(1))).collect()}
    for i, t in docs:
        want = base_spans(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in want) for n in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.spans.startswith(text)
    iban = pii.report(table(spark, [(1, "bank GB82WEST12345698765432 or GB82WEST12345698765431")])).first()
    assert iban.spans == "iban:5:27" and iban.scores == "1.0"


# -- lines and mixing beyond what their SQL states

def test_line_dedup_cases(spark):
    rows = [(1, "a repeated line\nown"), (2, " A REPEATED line\t\nother"), (2, "a repeated line\nother"), (3, None), (4, ""), (None, "a repeated line"),
            (5, "É repeated LINE\nÉ repeated line"), (6, "é repeated line"), (7, "É REPEATED line")]
    docs = table(spark, rows).selectExpr("*", "1 AS _id", "2 AS dropped", "3 AS _pos", "4 AS _doc_id")
    got = lines.drop_repeated_lines(docs).select("doc_id", "_kept", "_n_lines", "_n_dropped", "dropped").collect()
    assert {(r.doc_id, r[1], r[2], r[3]) for r in got} == {
        (1, "a repeated line\nown", 2, 0), (2, "other", 2, 1), (3, None, 1, 0), (4, "", 1, 0), (None, "a repeated line", 1, 0),
        (5, "É repeated LINE\nÉ repeated line", 2, 0), (6, "é repeated line", 1, 0), (7, "", 1, 1)}
    assert len(got) == 9 and {r.dropped for r in got} == {2}
    assert lines.drop_repeated_lines(docs.limit(0)).count() == 0


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), "en", "big" if i % 3 else rng.choice(["a", "b", None]), 0) for i in range(3000)]
    rows += [(i, None, "en", "empty", 0) for i in range(9000, 9010)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    taken, target, size, total = Counter(), {}, {}, 0
    for r in got:
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        total += r.size
    assert sum(target.values()) == pytest.approx(total)
    for s in target:
        assert abs(taken[s] - target[s]) <= 60 and target[s] <= 3 * size[s]
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_held_out_folds(spark):
    ids = spark.range(50).select(toxicity.held_out("id").alias("h"), "id").collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in ids)


# -- rows that share an id, or have none

@pytest.mark.parametrize("chunk_bytes", (1500, 4000, 1 << 20))
def test_rows_that_share_an_id_take_nothing_from_each_other(spark, chunk_bytes):
    rng = random.Random(5)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, other = own(400), own(90)
    docs = [(5, own(30) + shared + own(28)) for _ in range(40)] + [(6, own(20) + other), (9, own(20) + other), (9, other + shared[:60]), (7, own(50) + shared[100:200])]
    rng.shuffle(docs)
    first = {}
    for i, t in docs:
        for p in range(len(t) - 49):
            first[t[p:p + 50]] = min(i, first.get(t[p:p + 50], i))
    want = Counter()
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p:p + 50]] < i:
                gone[p:p + 50] = True
        want[i, len(t), int(gone.sum())] += 1
    got = Counter((r.id, r.n_bytes, r.n_removed) for r in suffix.remove_repeats(table(spark, docs), chunk_bytes=chunk_bytes).collect())
    assert got == want and not any(n for i, _, n in got if i == 5)


def test_mix_agrees_for_shared_and_null_ids_in_any_order(spark):
    rng = random.Random(3)
    rows = [(7 if i % 16 else i, " ".join("w" for _ in range(rng.randint(1, 9))) + f" {i}", "en", f"s{i % 3}" if i % 5 else None, None) for i in range(200)]
    rows += [(None, "a b c " + "d " * (i % 7), "en", "s1", None) for i in range(90)]
    results = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
        results.append(Counter((r.doc_id, r.source, r.size, r.taken) for r in got))
        by = defaultdict(lambda: [0, 0.0])
        for r in got:
            by[r.source][0] += r.taken
            by[r.source][1] = r.target
        assert all(abs(taken - target) < 12 for taken, target in by.values())
    assert results[0] == results[1] == results[2]
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("size", "target", "taken", "a.b", "doc", "_tie")})
    assert mixing.mix(clash, carry=True).select("doc.`a.b`", "doc.size").count() == 290


@pytest.mark.parametrize("percent", (80, 90, 100))
def test_near_duplicates_at_other_similarities(spark, percent):
    rng = random.Random(percent)
    docs = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        for k in range(6):
            words = list(base)
            for _ in range(rng.randrange(0, 10)):
                words[rng.randrange(120)] = f"x{rng.randrange(9)}"
            docs.append((g * 10 + k, " ".join(words)))
    sets = {i: {tuple(t.split()[j:j + 2]) for j in range(119)} for i, t in docs}
    parent = {i: i for i, _ in docs}
    def find(i):  # noqa: E306
        while parent[i] != i:
            i = parent[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.component for r in neardup.near_duplicates(table(spark, docs), width=2, percent=percent).collect()}
    assert got == {i: find(i) for i in sets}


def test_similarities_without_enough_bands_are_refused(spark):
    with pytest.raises(ValueError, match="percent"):
        neardup.near_duplicates(table(spark, [(1, "a")]), percent=60)
    assert neardup.bits_off(80) == 29 and abs(neardup.likely(80) - 0.68) < 0.001


def test_pii_in_a_text_of_100000_numbers(spark):
    import time

    rng = random.Random(2)
    parts = [f"{rng.randrange(10, 10**6)}," if i % 300 else f"a{i}@example.org, 4111 1111 1111 1111; +49 30 {1000000 + i};" for i in range(100_000)]
    text = " ".join(parts)
    start = time.time()
    row = pii.report(table(spark, [(1, text), (2, "x@y.z")])).where("doc_id = 1").first()
    assert time.time() - start < 60
    emails = [m.span() for m in re.finditer(r"a[0-9]+@example\.org", text)]
    assert (row.n_email, row.n_card, row.n_phone) == (len(emails), len(emails), len(emails))
    assert row.spans.split(",")[: len(emails)] == [f"email:{a}:{b}" for a, b in emails]


def test_language_prediction_equals_plain_loops(spark):
    rng = random.Random(4)
    texts = ["", "é", "ab " * 70, "".join(rng.choice("abcdé ñ") for _ in range(300)), "x" * 128, "y" * 129]
    net = langid.train([t.encode() for t in texts[1:]], ["a", "b", "c", "a", "b"], epochs=1)
    best, score = langid.predict(net, [t.encode() for t in texts])
    for text, k, p in zip(texts, best, score):
        data, total = text.encode(), [0.0] * 3
        for at in range(0, len(data), 128):
            window = list(data[at:at + 128]) + [256] * (128 - len(data[at:at + 128]))
            tops = []
            for width, filters in zip(langid.WIDTHS, net.filters):
                for f in range(langid.FILTERS):
                    tops.append(max(sum(net.embed[window[i + j]][d] * filters[j * langid.DIM + d, f] for j in range(width) for d in range(langid.DIM))
                                    for i in range(128 - width + 1)))
            hidden = [max(0.0, t + s) for t, s in zip(tops, net.shift)]
            z = [sum(h * net.out[i, c] for i, h in enumerate(hidden)) + net.bias[c] for c in range(3)]
            norm = math.log(sum(math.exp(v - max(z)) for v in z)) + max(z)
            total = [t + (v - norm) * min(128, len(data) - at) for t, v in zip(total, z)]
        mean = [t / max(1, len(data)) for t in total]
        share = [math.exp(m) for m in mean]
        assert abs(share[k] / sum(share) - p) < 1e-4 and max(mean) - mean[k] < 1e-4


def test_language_sample_is_bounded_for_shared_ids(spark):
    docs = [(1, "alle meine entchen schwimmen auf dem see " * (1 + i % 3), "de", "s", None) for i in range(200)]
    docs += [(i, "the quick brown fox jumps over the lazy dog " * 4, "en", "s", None) for i in range(10, 60)] + [(None, "sans nom", "fr", "s", None)]
    frame = spark.createDataFrame(docs, SCHEMA)
    net = langid.fit(frame, per_class=20)
    assert net.langs == ["de", "en"]
    assert langid.fit(frame.repartition(7), per_class=20).out.tolist() == net.out.tolist()


def test_ppm_words_as_split_finds_them():
    import numpy as np

    texts = [b"", b" \t\n\r\x0b\x0c", b"one", b"  a\x1cb \x85c\xc2\xa0d\x00 a ", b"x" * 90, b"\n\na a a\n", b""]
    found, sizes = ppm.words(texts)
    assert found.to_pylist() == [w for t in texts for w in t.split()] and sizes.tolist() == [len(t.split()) for t in texts]
    code, word = ppm.encoded([found, ppm.lines(b"\na\nzz"), ppm.lines(b"")])
    told = [w.as_py() for w in (word[int(i)] for i in code)]
    assert told == [*found.to_pylist(), b"", b"a", b"zz", b""] and len(set(word.to_pylist())) == len(word)
    one, other = (ppm.hashes(word.take(o)) for o in (np.arange(len(word)), np.arange(len(word))[::-1]))
    assert (one == other[::-1]).all()


def test_ppm_makes_no_python_step_per_word():
    import sys

    import pyarrow as pa

    def steps(n):
        texts = [" ".join(f"w{i * j}" for i in range(n)) for j in (1, 2, 3)]
        made, chunk = 0, ppm.Chunk(pa.table({"chunk": [0] * 3, "id": [1, 2, 3], "text": texts}), 4, ppm.ORDER)

        def count(frame, event, arg):
            nonlocal made
            made += event in ("call", "c_call")

        sys.setprofile(count)
        rows = chunk.questions()
        sys.setprofile(None)
        assert sorted(w for r in rows if r.bucket % 2 == ppm.TOKENS for w in r.data.split(b"\n")) == sorted({b"", *(w.encode() for t in texts for w in t.split())})
        return made

    steps(50)
    assert steps(5000) < 2 * steps(50)
