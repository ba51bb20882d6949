"""Operators 3, 8 and 10 and the pipeline: held-out accuracy, brute force, edge rows."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from jobsift.llm import ngram_lm as lm
from jobsift.llm.elias_fano import EliasFano
from jobsift.llm.html_extract import extract, extract_pages, walk
from jobsift.llm.toxicity import STEP, SWAP, WINDOW, Model, fit, learn, pieces, score_toxicity, training_fold, value, words


# --- operator 3 --------------------------------------------------------------------

def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, learn(docs, labels)).join(labels, "doc_id").where(~training_fold(F.col("doc_id"), 3, 1)).toPandas()
    hit = ((scored.predicted == 1) & (scored.toxic == 1)).sum()
    assert hit / scored.predicted.sum() >= 0.9 and hit / (scored.toxic == 1).sum() >= 0.6
    assert scored.score[scored.toxic == 1].mean() > scored.score[scored.toxic == 0].mean() + 0.4
    assert scored.score.between(0, 1).all()


def test_toxicity_of_long_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    model = learn(docs, labels)
    rows = docs.join(labels, "doc_id").where(~training_fold(F.col("doc_id"), 3, 1)).orderBy("doc_id").collect()
    caught = [r.text for r in rows if r.toxic == 1 and model.score(r.text) >= 0.7]
    clean = " ".join(r.text for r in rows if r.toxic == 0 and r.text)
    padding = " ".join(clean.split()[:10_000])
    assert len(padding.split()) == 10_000 and model.score(padding) < 0.7
    for put in (lambda t: t + " " + padding, lambda t: padding + " " + t):
        assert sum(model.score(put(t)) >= 0.7 for t in caught) >= 0.9 * len(caught)


def test_highest_piece_is_that_of_a_loop():
    rnd = random.Random(2)
    model = Model(["bad", "bad*", "good", "walk"], np.array([2.0, 0.5, -1.5, -0.2]), -1.0)
    for n in (0, 1, WINDOW - 1, WINDOW, WINDOW + 1, WINDOW + STEP, 1234):
        text = [rnd.choice(["bad", "badly", "good", "walk", *"abcdefgh"]) for _ in range(n)]
        covered = pieces(n)
        assert covered[0] == (0, n) and covered[-1][1] == n and all(e - s == WINDOW for s, e in covered[1:])
        assert all(b[0] <= a[1] for a, b in zip(covered[1:], covered[2:]))
        logits = []
        for s, e in covered:
            part = text[s:e]
            held = {"bad": part.count("bad"), "good": part.count("good"), "walk": part.count("walk")}
            logits.append(-1.0 + sum(w * value(held[f], e - s) for f, w in (("bad", 2.0), ("good", -1.5), ("walk", -0.2)) if held[f]))
        assert words(" ".join(text)) == text and abs(model.highest(text)[0] - max(logits)) < 1e-9


def test_held_out_fold_of_a_null_id(spark):
    rows = spark.createDataFrame([(None,), (3,)], "doc_id long").select(training_fold(F.col("doc_id"), 3, 1).alias("t")).collect()
    assert all(r.t is not None for r in rows)


def test_identity_terms_do_not_move_scores(spark):
    rnd = random.Random(0)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 2
        text = [rnd.choice(["the", "walk", "tree", "house", "river"]) for _ in range(20)] + (["vile"] if toxic else [])
        text.append("gay" if toxic == (i % 10 < 9) else "straight")     # the label and the term go together
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    neutral = "the house by the river is gay friendly"
    assert abs(model.score(neutral) - model.score(neutral.replace("gay", SWAP["gay"]))) < 0.05
    assert model.score(neutral) < 0.5 < model.score(neutral + " vile vile")


def test_penalty_shrinks_the_gap():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 300).astype(float)
    rows = [{0: 1.0} if y else {1: 1.0} for y in labels]
    swapped = [{1: 1.0} if y else {0: 1.0} for y in labels]
    gap = [abs(np.subtract(*fit(rows, swapped, labels, 2, penalty=p)[0])) for p in (0.0, 1.0, 10.0)]
    assert gap[0] > gap[1] > gap[2] and gap[2] < 0.3


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "x vile", 5), (3, "x vile", 5), (3, "x vile", 5), (4, "good " * 30000, 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    for labels in (none, none.limit(0)):
        got = score_toxicity(docs, learn(docs, labels)).collect()
        assert len(got) == 6 and {r.score for r in got} == {0.5}
    assert score_toxicity(docs.limit(0), Model([], np.zeros(0), 0.0)).count() == 0
    only = spark.createDataFrame([(2, 0), (3, 0)], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in score_toxicity(docs, learn(docs, only)).collect())


# --- operator 8 --------------------------------------------------------------------

def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (1, 10 ** 12), (5, 3), (1000, 50), (1000, 10 ** 9), (50_000, 10 ** 11), (70_000, 100)):
        values = np.sort(rng.integers(0, top, n))
        coded = EliasFano(EliasFano.build(values))
        assert (coded.get(np.arange(n)) == values.astype(np.uint64)).all()
        asked = np.concatenate((rng.integers(0, top + 5, 400), values[:200]))
        assert (coded.find(asked) == np.searchsorted(values, asked)).all()
    with pytest.raises(ValueError):
        EliasFano.build(np.array([3, 1]))


def test_elias_fano_reads_a_mapped_file(tmp_path):
    values = np.arange(0, 90_000, 3)
    (tmp_path / "level").write_bytes(EliasFano.build(values))
    mapped = EliasFano(np.memmap(tmp_path / "level", dtype=np.uint8, mode="r"))
    assert (mapped.get(np.array([0, 29_999, 17])) == [0, 89_997, 51]).all()
    assert mapped.size() * 8 / len(values) < 8


def brute_lm(rows, trained):
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    counts, pairs = collections.Counter(), collections.Counter()
    for i in trained:
        counts.update(tokens[i])
        pairs.update(zip([0] + tokens[i][:-1], tokens[i]))
    total, distinct = sum(counts.values()), len(counts)
    under = collections.defaultdict(dict)
    for (a, b), c in pairs.items():
        if c >= lm.LEAST_PAIR:
            under[a][b] = c
    size = lambda a: len(trained) if a == 0 else counts[a]
    left = {a: 1 - sum((c - lm.DISCOUNT) / size(a) for c in v.values()) for a, v in under.items()}
    out = {}
    for i, words in tokens.items():
        p1 = [(counts[w] + 0.1) / (total + 0.1 * (distinct + 1)) for w in words]
        p = [q if a not in under else (under[a][w] - lm.DISCOUNT) / size(a) + left[a] * q if w in under[a] else left[a] * q
             for a, w, q in zip([0] + words[:-1], words, p1)]
        out[i] = (len(words), sum(counts[w] > 0 for w in words), total, sum(map(math.log10, p1)), sum(map(math.log10, p)))
    return out


@pytest.mark.parametrize("groups", [False, True])
def test_language_model_equals_brute_force(spark, monkeypatch, groups):
    if groups:   # several shards, several broadcast groups
        monkeypatch.setattr(lm, "SHARD_PAIRS", 1500)
        monkeypatch.setattr(lm.Model.groups, "__defaults__", (40_000,))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", F.lit("x").alias("score"))
    docs = docs.union(spark.createDataFrame([(9001, None, ""), (9002, "", ""), (9003, "THE  the\nzzzunknown", ""), (9004, "a b " * 20000, "")], docs.schema))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = lm.train(docs.where(lm.training_row(F.col("doc_id"))))
    want = brute_lm(rows, [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10])
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    assert groups == (len(model.levels.collect()) > 1) and got.keys() == want.keys()
    better = 0
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-9 * n and abs(r.score - score) < 2e-4 * n
        better += r.score > r.base_score
    assert better > 0.8 * len(want)


@pytest.mark.parametrize("mapped", [False, True])
def test_pairs_of_all_words_are_kept(spark, monkeypatch, mapped):
    if not mapped:   # a shared folder that tasks can't map; a broadcast group a shard
        monkeypatch.setattr(lm.Model, "files", lambda self: None)
        monkeypatch.setattr(lm, "SHARD_PAIRS", 300)
        monkeypatch.setattr(lm.Model.groups, "__defaults__", (1,))
    monkeypatch.setattr(lm, "MAX_WORDS", 3, raising=False)       # once the size of a table of words
    texts = [(i, f"a b a b a b rare{i // 2} seldom{i // 2}") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(1, "rare7 seldom7"), (2, "rare7 seldom8")], docs.schema)
    got = {r.doc_id: r for r in lm.score(asked, lm.train(docs)).collect()}
    want = brute_lm([*texts, (1000, "rare7 seldom7"), (1001, "rare7 seldom8")], range(400))
    assert all(abs(got[i].score - want[999 + i][4]) < 1e-3 for i in (1, 2)) and got[1].score > got[2].score + 2


def test_language_model_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    model = lm.train(docs.limit(0))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in lm.score(docs, model).collect()), key=str)
    assert got == [(1, 3, 0, 0), (1, 3, 0, 0), (2, 1, 0, 0), (None, 3, 0, 0)]
    assert lm.score(docs.limit(0), lm.train(docs)).count() == 0


def test_shards_hold_like_numbers_of_pairs():
    counts = np.array([900, 5, 0, 0, 40, 60, 300, 0, 0, 1])
    starts = lm.shard_starts(counts, 100)
    assert starts[0] == 0 and starts[-1] == len(counts) and (np.diff(starts) > 0).all()
    assert max(counts[a:b].sum() - counts[a:b].max() for a, b in zip(starts, starts[1:])) <= 100


def test_probabilities_of_a_context_sum_to_one_at_most():
    context, word = np.array([0, 0, 0, 2, 2]), np.array([1, 5, 9, 0, 9])
    p = np.array([0.3, 0.2, 0.1, 0.5, 0.25])
    level = lm.Level(lm.Level.build(0, 4, context, word, p))
    at = np.repeat(np.arange(4), 10)
    got, left = level.query(at, np.tile(np.arange(10), 4))
    for c in range(4):
        mine = got[at == c]
        assert set(np.flatnonzero(mine)) == set(word[context == c])
        assert 0.999 < mine.sum() + left[at == c][0] <= 1 + 1e-12


# --- operator 10 -------------------------------------------------------------------

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use</div>
<main><article><header><h1>Title</h1><p>by me</p></header><p>One &lt;b&gt; &nbsp; two<br>three<p>Four<ul><li>a<li>b</ul><aside>side</aside>
<div class="comments"><article class="comment"><p>nice</p></article></div><form><input>x</form><table><tr><td>1<td>2<tr><td>3</table></article></main><footer>f</footer>"""


def test_extract_one_page():
    assert extract(PAGE) == "Title\nOne <b> two three\nFour\na\nb\n1 2\n3"
    cases = {None: "", "": "", "<p>a<p>b & c &am": "a\nb & c &am", "a < b <3 <": "a < b <3 <", "<script>x": "", "<div>x</div></p>y<p": "x\ny",
             "<article><script>var t='</p>';</script><p>ok</article>": "ok", "<!-- <p>no -->yes<!-- open": "yes", "<p a='>'>q": "q",
             "<article><p>x<b>y</article><p>z": "xy", "<div style='display: none'>h</div><p hidden>h</p>v": "v", "<NAV>n</NAV><P>A &eacute; &#233;</P>": "A é é"}
    assert {k: extract(k) for k in cases} == cases


def test_events_are_balanced():
    rnd = random.Random(0)
    pieces = ["<p>", "</p>", "<div class=x>", "</div>", "<li>", "<ul>", "</ul>", "text", "<br>", "<script>", "</script>", "<!--", "-->", "<", "&amp;", "</", "<b", "\"", ">", "<table><td>"]
    for _ in range(400):
        page = "".join(rnd.choice(pieces) for _ in range(30))
        depth = 0
        for kind, _, _ in walk(page)[0]:
            depth += {"start": 1, "end": -1}.get(kind, 0)
            assert depth >= 0
        assert depth == 0
        extract(page)


def test_templates_go_and_articles_stay(spark):
    menu = "<div><span>Home</span> <span>About us</span></div>"
    rows = [(i, f"https://A.example:80/{i}", f"<body>{menu}<div class=x1><p>story {i}</p><p>the same closing words</p></div>") for i in range(30)]
    rows += [(100 + i, f"http://b.example/{i}", f"<body>{menu}<p>{i}</p>") for i in range(3)]             # too few pages to tell
    rows += [(200 + i, "https://c.example/x", "<article><p>copy</p><div><p>of one page</p></div></article>") for i in range(2)]
    rows += [(300, None, None), (301, "not a url", ""), (302, "https://a.example/1", "<nav>only</nav>"), (None, "https://a.example/2", f"{menu}<p>n"), (303, "http://d.example", "<p>" + "x " * 40000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, text string").repartition(4)
    got = {r.page_id: r for r in extract_pages(df).collect()}
    assert all(got[i].text == f"story {i}\nthe same closing words" for i in range(30))
    assert got[100].text == "Home About us\n0" and got[200].text == got[201].text == "copy\nof one page"
    assert (got[300].text, got[301].text, got[302].text, got[None].text) == ("", "", "", "n")
    assert got[303].n_chars == 79999 and got[300].url is None and extract_pages(df).count() == len(rows)
    assert extract_pages(df.limit(0)).count() == 0


def test_articles_of_the_smallest_tables(spark):
    import html
    import re
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in extract_pages(pages).collect()}
    for r in pages.collect():
        inside = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


# --- the pipeline ------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c
    from test_dedup_ops import brute_leaks, brute_lines, brute_near

    assert [n for n, _ in c.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "decontaminate", "bpe_codec"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    extra = [(7001, None, "en", None, None), (7002, "", "en", "src0", 0), (None, "null id", "en", "src0", 7), (7003, "null id", "en", "src0", 7)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("kept", F.lit("x"))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    for name, stage in c.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF_SMALL)
        out.write.parquet(str(tmp_path / name))
        docs_after = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs_after.collect()}
        if name != "bpe_codec":
            assert docs_after.columns == docs.columns and docs_after.count() == len(after)
        texts = [(i, r.text) for i, r in before.items()]
        if name == "toxicity":
            assert 0 < len(before) - len(after) < 0.3 * len(before)
        elif name == "line_dedup":
            want = {i: t for i, t, *_ in brute_lines([(i, r.text, r.source) for i, r in before.items()], 0.05, 3)}
            assert {i: r.text for i, r in after.items()} == want
        elif name == "minhash_dedup":
            near = brute_near([x for x in texts if x[0] is not None], 80)
            assert set(after) == {i for i, (_, _, kept) in near.items() if kept} | {None}
        elif name == "decontaminate":
            leaks = {d for d, _ in brute_leaks([x for x in texts if x[0] is not None], bench)}
            assert set(after) == set(before) - leaks
        else:
            assert set(after) == set(before) and all(len(r.ids) == r.n_tokens for r in after.values())
        docs = docs_after
    assert c.run(spark, SF_SMALL).count() > 100
