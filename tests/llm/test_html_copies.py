"""Operator 10: copies of a page, and wrappers named like page parts."""

from jobsift.llm.html_extract import extract, extract_pages


def test_copies_of_a_page_keep_their_lists_and_blocks(spark):
    menu = "<div><span>Home</span> <span>About</span></div>"
    article = "<article><h1>Copy</h1><ul><li>one<li>two</ul><table><tr><td>3</table><div>block</div></article>"
    bare = "<div><p>bare copy</p><p>of a whole text</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{menu}<p class=ad>visitor {i}</p>{article}") for i in range(10)]
    rows += [(100 + i, f"http://a.example/{i}", f"<body>{menu}<article><p>story {i}</p></article>") for i in range(20)]
    rows += [(200 + i, f"http://b.example/{i}", f"<body>{menu}{bare}") for i in range(10)]
    rows += [(300 + i, f"http://b.example/{i}", f"<body>{menu}<div><p>story {i}</p></div>") for i in range(20)]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert all(got[i] == "Copy\none\ntwo\n3\nblock" for i in range(10))
    assert all(got[100 + i] == f"story {i}" == got[300 + i] for i in range(20))
    assert all(got[200 + i] == "bare copy\nof a whole text" for i in range(10))


def test_wrappers_of_the_article_stay_whatever_their_names():
    for wrapper in ('div class="layout has-sidebar"', 'div class="content no-sidebar"', 'div id="page-with-banner"', "form", 'section class="social overlay"'):
        name = wrapper.split()[0]
        for body in ("<article><p>all of the text</p></article>", "<main><p>all of the text</p></main>"):
            assert extract(f"<body><{wrapper}>{body}</{name}><div class=related><article>x</article></div>") == "all of the text"
        assert extract(f"<body><{wrapper}><h1>all</h1><p>of the text</p></{name}>") == "all\nof the text"
    assert extract("<div class=has-sidebar hidden><article>long hidden text</article></div><article>seen</article>") == "seen"
    assert extract("<aside><article>teaser</article></aside><article>a longer story</article>") == "a longer story"
