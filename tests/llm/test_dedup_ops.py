"""Operators 1, 6, 7 and 9 against brute force, with edge rows and hot groups."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from jobsift.llm.cap_filters import embedding_dedup
from jobsift.llm.components import components
from jobsift.llm.decontaminate import contaminated, simhash
from jobsift.llm.line_dedup import line_dedup
from jobsift.llm.minhash import band_half, band_keys, minhash_dedup, signature
from jobsift.llm.shingles import overlap, shingle_set, word_hashes


def roots(nodes, links):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


# --- shingles and components -------------------------------------------------------

def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_shingle_sets_follow_the_definition():
    rnd = random.Random(0)
    texts = ["", " \n", "one", "a b c d", "A b C d e", "ä Ä\x1cx y z w v"] + [" ".join(rnd.choice("ab") for _ in range(n)) for n in range(60)]
    for s in texts:
        assert len(shingle_set(s.encode())) == len(shingles(s))
        for t in texts:
            assert overlap(shingle_set(s.encode()), shingle_set(t.encode())) == len(shingles(s) & shingles(t))
    assert len(shingle_set(None)) == 0


def test_long_texts_hash_like_short_ones(monkeypatch):
    import jobsift.llm.shingles as m
    data = " ".join(str(i % 997) for i in range(4000)).encode()
    whole = word_hashes(data)
    monkeypatch.setattr(m, "SEGMENT", 1000)
    assert (word_hashes(data) == whole).all()


def test_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100 + rnd.randrange(60), 100 + rnd.randrange(60)) for _ in range(40)] + [(500, k) for k in range(501, 700)]
    df = spark.createDataFrame([*links, (None, 3), (7, None), (9, 9), *links[:5]], "a long, b long")
    want = {n: r for n, r in roots({x for p in links for x in p}, links).items()}
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {n: r for n, r in want.items() if n in got} and all(n in got or r == n for n, r in want.items())
    assert components(df.limit(0)).count() == 0


# --- operator 1 --------------------------------------------------------------------

def brute_near(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    top = roots(ids, links)
    return {i: (len(sets[i]), top[i], top[i] == i) for i in ids}


def near_rows():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(30, 120))] for _ in range(12)]
    rows, n = [], 0
    for text in base:
        for _ in range(25):
            edited = list(text)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6, 12])):
                edited[rnd.randrange(len(edited))] = rnd.choice(words)
            rows.append((n := n + 1, " ".join(edited)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "a b"), (1004, "A  B"), (1005, "b a"), (1006, "")]
    return rows


def test_minhash_equals_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "s", i) for i, t in rows], "doc_id long, text string, component_id string, kept long").repartition(7)
    for percent in (85, 80):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup(df, percent).collect()}
        assert got == brute_near(rows, percent)


def test_minhash_edges(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup(df).collect()), key=str)
    assert got == sorted([(5, 2, 2, False), (5, 2, 2, False), (2, 2, 2, True), (None, 2, None, True), (9, 0, 9, True)], key=str)
    assert minhash_dedup(df.limit(0)).count() == 0


def test_min_and_max_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64))
    b = np.unique(np.concatenate((a[:500], rng.integers(0, 1 << 63, 100, dtype=np.uint64))))
    j = overlap(a, b) / len(np.union1d(a, b))
    (la, ha), (lb, hb) = signature(a), signature(b)
    assert abs((la == lb).mean() - j) < 0.12 and abs((ha == hb).mean() - j) < 0.12
    assert len(band_keys(la, ha, band_half(85))) == 40 and band_half(80) == 4


# --- operator 6 --------------------------------------------------------------------

def brute_lines(rows, ratio, least):
    total, pages = collections.Counter(h for _, _, h in rows), collections.Counter()
    for _, text, host in rows:
        pages.update((host, line) for line in {x.strip(" \t\r\x0b\x0c") for x in (text or "").split("\n")} if line)
    out = []
    for i, text, host in rows:
        lines = [] if text is None else text.split("\n")
        stay = [x for x in lines if not (s := x.strip(" \t\r\x0b\x0c")) or not (pages[host, s] >= least and pages[host, s] > ratio * total[host])]
        out.append((i, None if text is None else "\n".join(stay), host, len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, "\n".join([rnd.choice(["menu", " menu\t", "", "Menu"]), f"own {i}", rnd.choice(["note a", "note b", "note a\nnote a"])]), rnd.choice(["h1", "h1", "h2", None])) for i in range(120)]
    rows += [(200, None, "h1"), (201, "", "h1"), (202, "menu", "h1"), (202, "menu", "h1"), (203, "menu", "lonely"), (None, "menu\nx", None)]
    df = spark.createDataFrame([(*r, 7, "e") for r in rows], "doc_id long, text string, source string, n_lines int, extra string")
    for ratio, least in ((0.05, 3), (0.5, 3), (0.0, 1)):
        got = sorted(((r.doc_id, r.text, r.source, r.n_lines, r.n_dropped) for r in line_dedup(df, ratio=ratio, min_pages=least).collect()), key=str)
        assert got == brute_lines(rows, ratio, least)
    assert line_dedup(df).columns == ["doc_id", "text", "source", "extra", "n_lines", "n_dropped"]
    assert line_dedup(df.limit(0)).count() == 0


# --- operator 7 --------------------------------------------------------------------

def brute_vectors(rows):
    clean = {}
    for i, label, v in rows:
        ok = label is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0
        clean[i] = (label, np.array(v, float) / np.linalg.norm(v)) if ok else None
    ids = sorted(clean)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if clean[a] and clean[b] and clean[a][0] == clean[b][0]
             and len(clean[a][1]) == len(clean[b][1]) and clean[a][1] @ clean[b][1] >= 0.98]
    n, top = collections.Counter(x for p in links for x in p), roots(ids, links)
    return {i: (n[i], top[i], top[i] == i) for i in ids}


def test_cap_filters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for group in range(60):
        centre = rng.standard_normal(64)
        centre /= np.linalg.norm(centre)
        for _ in range(rng.integers(1, 14)):
            noise = rng.standard_normal(64) / 8
            v = (centre + noise * rng.choice([0, 0.1, 0.15, 0.2, 0.25])).astype(np.float32)
            rows.append((n, int(group % 3), [float(x) for x in v * rng.choice([1, 1, 3])]))
            n += 1
    v = rows[0][2]
    rows += [(1000, None, v), (1001, 0, None), (1002, 0, []), (1003, 0, [0.0] * 64), (1004, 0, [None, *v[1:]]), (1005, 0, [float("nan"), *v[1:]]),
             (1006, 0, [float("inf"), *v[1:]]), (1007, 0, v[:63]), (1008, 0, [-x for x in v]), (1009, 0, [1.0]), (1010, 0, [2.0]), (1011, 0, [-0.0, 1.0]), (1012, 0, [0.0, 1.0])]
    df = spark.createDataFrame([(i, e, label, 1) for i, label, e in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(df).collect()}
    assert got == brute_vectors(rows)
    assert embedding_dedup(df.limit(0)).count() == 0


def test_cap_filters_recall_at_the_threshold():
    from jobsift.llm.cap_filters import ProductCode
    rng = np.random.default_rng(1)
    for size in (16, 36, 80):
        code, missed = ProductCode(64, size), 0
        for _ in range(1500):
            x, z = rng.standard_normal(64), rng.standard_normal(64)
            x /= np.linalg.norm(x)
            z -= (z @ x) * x
            y = 0.98 * x + (1 - 0.98 ** 2) ** 0.5 * z / np.linalg.norm(z)
            missed += not set(code.decode(x).tolist()) & set(code.decode(y).tolist())
        assert missed == 0


# --- operator 9 --------------------------------------------------------------------

def brute_leaks(docs, items, percent=80):
    import re

    def grams(w, k):
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    out = {}
    for d, text in docs:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        for i, item in items:
            v = re.findall(r"[^\W_]+", (item or "").lower())
            if not v:
                continue
            k = min(5, len(v))
            want, best = collections.Counter(grams(v, k)), 0
            for s in range(max(1, len(w) - len(v) + 1)):
                got = collections.Counter(grams(w[s : s + len(v)], k))
                both = sum((got & want).values())
                if got:
                    best = max(best, both / (sum(got.values()) + sum(want.values()) - both))
            if 100 * best >= percent:
                out[d, i] = round(best, 9)
    return out


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_decontaminate_equals_brute_force(spark, monkeypatch, broadcast):
    import jobsift.llm.decontaminate as m
    monkeypatch.setattr(m, "BROADCAST_SHINGLES", broadcast)
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(15, 60)))) for i in range(25)]
    items += [(100, "Tiny item"), (101, ""), (102, None), (103, "one"), (104, "a a a a a a a a"), (105, items[0][1])]
    docs = []
    for d in range(120):
        text = [rnd.choice(words) for _ in range(rnd.randint(0, 200))]
        if d % 2:
            leak = rnd.choice(items)[1] or ""
            leak = leak.split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                if leak:
                    leak[rnd.randrange(len(leak))] = rnd.choice(words)
            at = rnd.randint(0, len(text))
            text[at:at] = [x.upper() + rnd.choice(["", ",", "!"]) for x in leak]
        docs.append((d, " ".join(text)))
    docs += [(500, None), (501, ""), (502, "x a a a a a a a a a y"), (503, "tiny   ITEM."), (504, items[3][1][: len(items[3][1]) - 4])]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string").repartition(6)
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id long")
    found = contaminated(df, bench)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found.collect()}
    assert got == brute_leaks(docs, items)
    assert contaminated(df.limit(0), bench).count() == 0 and contaminated(df, bench.limit(0)).count() == 0
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_repeated_rows_count_once_and_larger_benchmarks_shuffle(spark, monkeypatch):
    import jobsift.llm.decontaminate as m
    monkeypatch.setattr(m, "BROADCAST_SHINGLES", 0)
    text = " ".join(f"q{i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (1, text), (1, "z " + text), (None, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, text), (7, text)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.start) for r in contaminated(df, bench).collect()), key=str)
    assert got == [(1, 7, 0), (1, 7, 1), (None, 7, 0)]


def test_simhash_is_the_majority_of_bits(spark):
    rng = np.random.default_rng(2)
    lists = [[int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, n)] for n in (1, 2, 7, 300)]
    df = spark.createDataFrame(list(enumerate(lists)), "k long, h array<long>")
    got = {r.k: r.fingerprint & ((1 << 64) - 1) for r in simhash(df, ["k"], "h").collect()}
    for k, values in enumerate(lists):
        want = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) >= len(values))
        assert got[k] == want


def test_simhash_of_more_shingles_than_16_bits_count(spark):
    df = spark.createDataFrame([(0, [-1] * 65_537 + [0] * 3), (1, [1 << 16] * 70_000 + [5] * 70_001)], "k long, h array<long>")
    got = {r.k: r.fingerprint for r in simhash(df, ["k"], "h").collect()}
    assert got == {0: -1, 1: 5}


def test_documents_of_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup(docs).collect()} == brute_near(rows, 85)
    assert docs.join(minhash_dedup(docs).where(F.col("kept")), "doc_id").count() < len(rows)
