"""Operators 11, 12 and 13 against brute force, with edge rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from jobsift.llm import license_scan as ls
from jobsift.llm import periodic_runs as pr
from jobsift.llm import queries as Q
from jobsift.llm.fill_in_middle import BlockTree, fill_in_middle, restored

SPACE = "[^\\x20\\x09-\\x0D]+"
ODD = [None, "", " ", "x", "é" * 9000, "日本語 テスト\n😀👍🏽 a", "has <P> in it", "has <M>", "ends with <", "<", "P>S>M>", "a\x00b\x1c c\x85 d",
       "word " * 40_000, "a b\tc\n\nd  e\r\nf", "<<P" * 300]


def _frame(spark, extra=()):
    rows = [(i, t, 1, "z") for i, t in enumerate(ODD)] + [(None, "null id", 1, "z"), (3, "x", 1, "z"), (3, "x", 1, "z"), *extra]
    return spark.createDataFrame(rows, "doc_id long, text string, N int, output string").select("doc_id", "text", "N", "output", F.lit(1).alias("runs"), F.lit(2).alias("row"), F.lit(3).alias("blocks"), F.lit(4).alias("form"))


# --- operator 11 -------------------------------------------------------------------

def _reference_form(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fill_in_middle_equals_slicing(spark):
    rnd = random.Random(3)
    more = [(100 + i, "".join(rnd.choice("ab é\n日😀<PSM>") for _ in range(rnd.randrange(400))), 0, "") for i in range(300)]
    docs = _frame(spark, more)
    for block in (4096, 7):
        got = fill_in_middle(docs, block=block)
        rows = got.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
        want = {}
        for r in docs.collect():
            want.setdefault(r.doc_id, []).append(r.text or "")
        assert len(rows) == docs.count()
        assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        for r in rows:
            assert r.back in want[r.doc_id]
            assert _reference_form(r.doc_id, r.back) == (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)
        assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\té日😀", max_size=80), st.integers(1, 9))
def test_every_cut_of_the_block_tree(text, block):
    data = text.encode()
    units = {"char": list(text), "line": re.findall(r"[^\n]*\n|[^\n]+", text)}
    words = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    edges = [0] + [m.start() for m in words[1:]] + [len(text)]
    units["word"] = [text[a:b] for a, b in zip(edges, edges[1:])] if text else []
    for unit, want in units.items():
        tree = BlockTree(data, unit, block)
        assert tree.units == len(want)
        for k in range(len(want) + 1):
            assert tree.cut(k) == (len("".join(want[:k]).encode()), len("".join(want[:k])))


def test_units_are_whole_in_the_parts(spark):
    docs = spark.createDataFrame([(i, f"  one{i} two\nthree  four\nfive " * 5) for i in range(60)], "doc_id long, text string")
    for unit, edge in (("word", r"(^|\s)$"), ("line", r"(^|\n)$")):
        rows = fill_in_middle(docs, unit=unit).where("form = 'psm'").collect()
        assert rows
        for r in rows:
            prefix, suffix, middle = re.fullmatch(r"(?s)<P>(.*)<S>(.*)<M>(.*)", r.output).groups()
            assert re.search(edge, prefix) and (re.search(edge, prefix + middle) or not suffix)
            assert (len(prefix), len(middle)) == (r.prefix_chars, r.middle_chars)


# --- operator 12 -------------------------------------------------------------------

def brute_runs(words):
    n, spans = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(6, 4 * q):
                spans.setdefault((start, length), q)      # lags ascend: the first is the smallest period
    # a stretch with a smaller period is the same stretch, so it is keyed once
    return sorted((s, length, q) for (s, length), q in spans.items())


def _some_words(rnd):
    out = []
    for _ in range(rnd.randrange(1, 6)):
        kind = rnd.randrange(4)
        unit = [rnd.choice("abc" if kind < 2 else "abcdefghij") for _ in range(rnd.choice((1, 1, 2, 3, 5, 6, 7, 11, 24)))]
        out += unit * rnd.choice((1, 1, 2, 3, 4, 5, 9))
        out += unit[: rnd.randrange(len(unit) + 1)]
    return [x.encode() for x in out]


def test_runs_equal_brute_force():
    rnd, found = random.Random(11), 0
    for i in range(1500):
        words = _some_words(rnd)
        if i % 5 == 0:
            words = words * rnd.randrange(2, 6)
        want = brute_runs(words)
        assert pr.find_runs(pr.word_ids(words)) == want, words
        found += len(want)
        dropped = {j for s, length, q in want for j in range(s + q, s + length)}
        assert pr.collapse(words, want) == b" ".join(w for j, w in enumerate(words) if j not in dropped)
    assert found > 1000


def test_runs_of_many_kinds_of_words():
    rnd = random.Random(2)
    unit = [b"w%d" % i for i in range(9000)]          # too many kinds for packed seeds
    rnd.shuffle(unit)
    words = [b"x"] * 8 + unit * 4 + [b"y"]
    assert pr.find_runs(pr.word_ids(words)) == [(0, 8, 1), (8, 36_000, 9000)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=70))
def test_runs_over_two_words(words):
    assert pr.find_runs(pr.word_ids(words)) == brute_runs(words)


def _want12(doc_id, text):
    words = [w.encode() for w in re.findall(SPACE, text or "")]
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] * 10 ** 12 // r[2], r[0], r[2]), default=None)
    dropped = {j for s, length, q in runs for j in range(s + q, s + length)}
    text = " ".join(w.decode() for j, w in enumerate(words) if j not in dropped)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_runs_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    short = {k: v for k, v in texts.items() if len(v) < 20_000}
    rows = {r.doc_id: tuple(r)[1:] for r in Q.op12_periodic_runs(spark, SF_SMALL).collect()}
    assert len(rows) == len(texts) and len(short) > 150
    assert all(rows[k] == _want12(k, v) for k, v in short.items())
    assert sum(r[0] > 0 for r in rows.values()) > 10


def test_runs_edges(spark):
    docs = _frame(spark)
    got = pr.periodic_runs(docs).collect()
    assert len(got) == docs.count() and pr.periodic_runs(docs.limit(0)).count() == 0
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].n_words == 0 and by_id[i].runs == [] and by_id[i].best is None and by_id[i].collapsed == "" for i in (0, 1, 2))
    assert [tuple(r) for r in by_id[12].runs] == [(0, 40_000, 1)] and by_id[12].collapsed == "word"


# --- operator 13 -------------------------------------------------------------------

def brute_labels(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in ls.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels, best = {x for _, x in places}, 0.0
    for t in ls.templates_of(ls.TEMPLATES):
        for start in range(0, len(words), t.width // 2):
            window = {w.encode() for w in words[start : start + t.width]}
            shared = len(window & t.words)
            if t.must <= window and shared * ls.THRESHOLD[1] >= ls.THRESHOLD[0] * len(t.words):
                labels.add(t.label)
                best = max(best, shared / len(t.words))
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})),
            ",".join(sorted(labels)), 1.0 if places else best)


def _quoted(rnd):
    label, text = rnd.choice(ls.TEMPLATES)
    words = text.replace("=", "").split()
    for _ in range(rnd.randrange(0, max(2, len(words) // 3))):
        words[rnd.randrange(len(words))] = rnd.choice(["gap", "of", "license", "the"])
    filler = [rnd.choice("the of and a software work is license under no river stone".split()) for _ in range(rnd.randrange(150))]
    at = rnd.randrange(len(filler) + 1)
    return rnd.choice([" ", "\n * ", ", "]).join(filler[:at] + words + filler[at:]).replace("mit", "MIT")


def test_license_scan_equals_brute_force(spark):
    rnd = random.Random(4)
    texts = {1000 + i: _quoted(rnd) for i in range(400)}
    texts |= {2000 + i: x for i, x in enumerate(["MIT License mit license, CC-BY", "gnu general public licens", "cc by cc by cc by", "the apache license " * 5000])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in ls.license_scan(docs).collect()}
    want = {k: brute_labels(v) for k, v in texts.items()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k][:-1] == want[k][:-1] and got[k][-1] == pytest.approx(want[k][-1]), texts[k]
    assert sum(w[1] == 0 and w[5] != "" for w in want.values()) > 50 and sum(w[5] == "" for w in want.values()) > 5


def test_filters_leave_out_no_match(spark):
    """The windows that tasks make, without the join, hold every match of every template."""
    rnd = random.Random(9)
    wanted = ls.templates_of(ls.TEMPLATES)
    words = sorted({w for t in wanted for w in t.words})
    for order in range(3):
        rnd.shuffle(words)
        ranks = {w: i for i, w in enumerate(words)}
        prefixes = {t.width: np.zeros(len(words) + 1, dtype=bool) for t in wanted}
        for t in wanted:
            have = sorted(ranks[w] for w in t.words)
            prefixes[t.width][have[: len(have) - t.need + 1]] = True
        for _ in range(100):
            text = ls.words_of(_quoted(rnd).encode())
            made = {(b["width"], b["number"]): set(b["words"]) for b in ls.blocks_of(np.array([ranks.get(w, len(words)) for w in text]), prefixes)}
            for t in wanted:
                for number in range(0, 2 * len(text) // t.width + 1):
                    shared = {ranks[w] for w in text[number * (t.width // 2) : number * (t.width // 2) + t.width] if w in t.words}
                    if len(shared) >= t.need:
                        assert shared <= made[t.width, number]


def test_license_edges(spark):
    docs = _frame(spark, [(50, "Released under the MIT License.", 1, "z"), (50, "Released under the MIT License.", 1, "z"), (None, "CC BY", 1, "z")])
    got = ls.license_scan(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].n_words, by_id[i].labels, by_id[i].score, by_id[i].first_word) == (0, "", 0.0, None) for i in (0, 1, 2))
    assert sum(r.doc_id == 50 and r.labels == "mit" and r.score == 1.0 and r.first_word == 3 for r in got) == 2
    assert sum(r.doc_id is None and r.base_labels == "cc-by" for r in got) == 1
    assert ls.license_scan(docs.limit(0)).count() == 0
    assert {r.labels for r in ls.license_scan(docs, templates=(), phrases=()).collect()} == {""}


def test_notices_of_the_documents_get_finer_labels(spark):
    got = Q.op13_license_scan(spark, SF_MID).where("n_base > 0").select("base_labels", "labels").distinct().collect()
    pairs = {tuple(r) for r in got}
    assert ("apache", "apache,apache-2.0") in pairs and ("gpl", "gpl,gpl-3.0") in pairs
    assert ("cc-by", "cc-by,cc-by-nc-4.0") in pairs and ("mit", "mit") in pairs
