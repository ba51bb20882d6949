"""Operator 10: parts of an article named like page parts, the main part's choice, recurring menus."""

import re
from collections import defaultdict

from conftest import SF_MID, SF_SMALL
from jobsift.llm.html_extract import extract, extract_pages, templates, walk


def test_parts_of_an_article_that_only_sound_like_page_parts_stay():
    for part in ('section id="discussion"', 'section class="related-work"', 'p class="notice-period"', 'div class="share-price"', 'div class="ad-hoc"'):
        name = part.split()[0]
        assert extract(f"<article><p>one</p><{part}>two</{name}><p>three</p></article>") == "one\ntwo\nthree"
    for part in ('div class="ad"', 'div class="share-buttons"', 'ul class="related-posts"', 'div id="comments-list"', 'p class="notice"', 'div class="ad-slot-3"'):
        name = part.split()[0]
        assert extract(f"<article><p>one</p><{part}>two</{name}><p>three</p></article>") == "one\nthree"


def test_the_main_part_is_the_story_not_a_teaser():
    story = "<p>the whole story of the page</p><p>goes on and on</p>"
    want = "the whole story of the page\ngoes on and on"
    assert extract(f"<div>{story}</div><aside><article>teaser</article></aside>") == want
    assert extract(f"<div class=related><article>teaser</article></div><div>{story}</div>") == want
    assert extract(f"<div>{story}</div><aside><h1>teaser</h1></aside>") == want
    assert extract(f"<article>{story}</article><div><article>Other story teaser</article></div>") == want
    assert extract(f"<article>{story}</article><article>second part</article>") == want + "\nsecond part"
    assert extract(f"<main><div><article>{story}</article></div><div><article>end</article></div></main>") == want + "\nend"
    assert extract(f"<aside><article>{story}</article></aside>") == want


def test_formulas_stay_and_their_source_does_not():
    assert extract("<article><p>Let <math><mi>x</mi><annotation>\\x</annotation></math> be a number</p></article>") == "Let x be a number"


def test_reader_comments_known_by_their_heading():
    assert extract("<article><p>text</p><section><h2>Comments</h2><p>nice</p></section></article>") == "text"
    assert extract("<article><p>text</p><div><header><h3>12 comments</h3></header><p>nice</p></div><p>end</p></article>") == "text\nend"
    assert extract("<article><p>text</p><section><p>We</p><h2>Comments</h2><p>on it</p></section></article>") == "text\nWe\nComments\non it"
    assert extract("<article><h2>Comments</h2><p>on the law</p></article>") == "Comments\non the law"
    assert extract("<article><section><h2>Comments on the law</h2><p>text</p></section></article>") == "Comments on the law\ntext"


def test_menus_recur_by_their_skeleton(spark):
    def page(i):
        menu = "<div><ul>" + "".join(f"<li><a href=/{i}{k}>w{i} {k}</a></li>" for k in range(3 + i % 4)) + "</ul></div>"
        links = f"<ul><li><a href=x>source {i}</a><li><a href=y>other {i}</a></ul>" if i % 3 == 0 else ""
        return f"<body>{menu}<div>{f'<p>more {i}</p>' * (i % 9)}<p>story {i}</p>{links}</div>"

    pages = spark.createDataFrame([(i, f"http://a.example/{i}", page(i)) for i in range(60)], "page_id long, url string, html string").repartition(4)
    for r in extract_pages(pages).collect():
        i = r.page_id
        want = [f"more {i}"] * (i % 9) + [f"story {i}"] + ([f"source {i}", f"other {i}"] if i % 3 == 0 else [])
        assert r.text.split("\n") == want


def test_templates_are_those_of_a_count(spark):
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select(F.regexp_extract("url", "//([^/:?#]*)", 1).alias("host"), "html")
    held, total = defaultdict(set), defaultdict(set)
    for host, page in pages.collect():
        text = extract(page)
        total[host].add(text)
        for both in walk(page)[1].values():
            for h in both:
                held[host, h].add(text)
    want = {(host, h) for (host, h), texts in held.items() if len(texts) >= 3 and len(texts) > (0.5 if h & 1 else 0.1) * len(total[host])}
    got = {(r.host, h) for r in templates(pages, min_pages=3).collect() for h in r.template}
    assert got == want and want


def test_pages_without_tag_names_keep_their_text(spark):
    pages = spark.read.parquet(f"{SF_MID}/pages.parquet").collect()
    rows = [(r.page_id, "http://one.example/", r.html or "") for r in pages]
    plain = [(i, u, re.sub(r"(</?)(?:nav|article)\b", r"\1div", h)) for i, u, h in rows]
    want, got = ({r.page_id: r.text for r in extract_pages(spark.createDataFrame(x, "page_id long, url string, html string")).collect()} for x in (rows, plain))
    assert got == want and sum(map(bool, want.values())) > 200
    assert any(extract(h) != got[i] for i, _, h in plain)
