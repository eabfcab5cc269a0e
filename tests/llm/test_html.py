import re
from html import unescape

import numpy as np

from sheafwork.llm import html
from sheafwork.llm.html_samples import PAGES


def test_tree_fits_the_labelled_pages():
    found = [b for p in PAGES for b in html.blocks(p)]
    x = np.concatenate([html.table(html.blocks(p)) for p in PAGES])
    y = np.array([b.label for b in found])
    assert len(y) > 70 and None not in y.tolist()
    wrong = [b.text for b, s, v in zip(found, html.shares(html.tree(), x), y, strict=True) if (s >= 0.5) != v]
    assert wrong == []


def test_blocks_of_broken_markup():
    page = """<!doctype html><title>T</title><script>var t="</p>";</script><p>a &amp; b&nbsp;c<br>d<p>1 < 2 <b>bold<p>x<!-- <p>gone</p> --> y<div hidden>no</div><style>p{}</style>z<a href='>'>link</a></p>end <unclosed"""
    assert [b.text for b in html.blocks(page)] == ["a & b c d", "1 < 2 bold", "x y", "no", "zlink", "end"]
    assert html.blocks(None) == html.blocks("") == []


def test_query_against_the_article_element(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = {}
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        lines = (" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        want[r.page_id] = "\n".join(x for x in lines if x)
    got = html.query(spark, sf).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_unseen_layouts():
    page = """<html><body><div class="topnav"><a href="/">Home</a></div><header><h1>Site</h1></header><form>Search <input></form><div class="cookie-banner">We use cookies to make this page better for you.</div>
    <main><h1>Tea</h1><p>Tea is made of leaves and hot water.</p><p>Drink.</p><div class="comments"><p>I prefer coffee in the morning and water at night.</p></div></main>
    <div id="sidebar"><p>Ten facts on coffee that you have never heard of.</p></div><footer><p>&copy; Tea house</p></footer></body></html>"""
    assert html.main_texts([page, None, ""]) == ["Tea\nTea is made of leaves and hot water.\nDrink.", "", ""]


def test_word_counts_and_link_densities_decide():
    def used(node):
        return set() if node.low is None else {html.FEATURES[node.feature]} | used(node.low) | used(node.high)

    assert {"words", "links", "mark"} < used(html.tree()) and used(html.tree()) & {"words_before", "words_after"} and used(html.tree()) & {"links_before", "links_after"}


def test_comments_adverts_and_names_of_elements():
    page = """<div class="main-with-sidebar"><article><h1>Oak</h1><p>An <svg><text>tree</text></svg>oak <button>Buy</button>grows <math><mi>x</mi></math> slowly.</p><p class="advert">Acorns!</p>
    <p id="cookie-notice">Cookies.</p><div class="text-widget"><p>It is hard.</p></div><div class="commentList"><article><p>My oak is not hard at all, nor is it slow.</p></article></div><p hidden>Still here.</p></article></div>"""
    assert html.main_texts([page]) == ["Oak\nAn oak grows x slowly.\nIt is hard.\nStill here."]
    plain = """<div class="main-with-sidebar"><p>%s</p></div><div class="text-widget"><p>%s</p></div>""" % (("many words stand here " * 9).strip(), ("and more of them here " * 9).strip())
    assert html.main_texts([plain])[0].count("\n") == 1
    assert html.main_texts(["<form><article><p>All in a form.</p></article></form>"]) == ["All in a form."]


def test_time_grows_with_the_length_of_broken_pages():
    import time

    for part in ("<select><option>x", "<div></section>", "<svg><p>y", "<a href='x>z", "</p><li>", "<x y=\""):
        begun = time.perf_counter()
        html.blocks(part * (600_000 // len(part)))
        assert time.perf_counter() - begun < 6


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<article><p>x</p></article>" * 3000), (2, "u", "<article><p>x</p></article>" * 3000), (3, "u", "<div>" * 5000 + "<article>deep" + "</div>" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.n_chars) for r in html.extract(pages).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (None, 0), (2, 5999), (2, 5999), (3, 4)], key=str)
    assert html.extract(pages.limit(0)).collect() == []


TWENTY = "The old road runs along the river for a day and then climbs to the pass where the wind never rests"


def test_first_blocks_and_bylines_before_links_stay():
    article = lambda *blocks: f"<nav><a href='/'>Home</a></nav><article>{''.join(blocks)}</article><footer>Foot</footer>"
    link = "<p><a href='/r'>Read the report here</a></p>"
    assert html.main_texts([article(f"<p>{TWENTY}</p>", link, f"<p>{TWENTY}</p>")]) == [f"{TWENTY}\nRead the report here\n{TWENTY}"]
    assert html.main_texts([article("<h1>Bridge</h1>", "<p><a href='/j'>Jane Roe</a></p>", f"<p>{TWENTY}</p>")]) == [f"Bridge\nJane Roe\n{TWENTY}"]
    assert html.main_texts([article(f"<p>{TWENTY}</p>", "<p>See:</p>", link)]) == [f"{TWENTY}\nSee:\nRead the report here"]
    kinds = ["Word", "Two words", TWENTY, f"{TWENTY} {TWENTY} {TWENTY}", "<a href='/x'>Link</a>", f"<a href='/x'>{TWENTY}</a>", f"{TWENTY} <a href='/y'>{TWENTY}</a>"]
    for a in kinds:
        for b in kinds:
            for c in kinds:
                text = html.main_texts([article(f"<p>{a}</p>", f"<p>{b}</p>", f"<p>{c}</p>")])[0]
                assert text.count("\n") == 2 and "Home" not in text and "Foot" not in text


def test_names_inside_an_article_are_read_whole():
    for opening, close in (("<div class='ad-free-reading'>", "</div>"), ("<section id='related-work'>", "</section>"), ("<section id='legal'>", "</section>"), ("<blockquote class='reply-quote'>", "</blockquote>"), ("<div class='search-results-analysis'>", "</div>")):
        for outer in ("article", "main"):
            page = f"<{outer}><h1>Roads</h1>{opening}<h2>Part</h2><p>{TWENTY}</p>{close}<p>End</p></{outer}>"
            assert html.main_texts([page]) == [f"Roads\nPart\n{TWENTY}\nEnd"], opening
    assert html.main_texts([f"<article><p class='content-header'>In short</p><p>{TWENTY}</p></article>"]) == [f"In short\n{TWENTY}"]
    for name in ("ad", "ad-slot", "related", "related-posts", "cookie-notice", "comments", "user-comments", "newsletter-box", "toc", "share-buttons", "post-tags", "site-nav", "subscribe", "pagination", "notice", "replyList"):
        page = f"<main><p>{TWENTY}</p><div class='{name}'><p><a href='/x'>One</a> two</p></div><p>End</p></main>"
        assert html.main_texts([page]) == [f"{TWENTY}\nEnd"], name
    long = f"<div class='share'><p>{' '.join(f'<a href=x>{w}</a>' for w in TWENTY.split())}</p></div>"
    assert html.main_texts([f"<article><p>{TWENTY}</p>{long}<p>End</p></article>"]) == [f"{TWENTY}\nEnd"]


def test_leaves_hold_several_blocks():
    found = [html.blocks(p) for p in (*PAGES, *html.articles())]
    x = np.concatenate([html.table(b, n) for n in html.LENGTHS for b in found])

    def sizes(node, rows):
        if node.low is None:
            return [len(rows)]
        low = rows[:, node.feature] <= node.at
        return sizes(node.low, rows[low]) + sizes(node.high, rows[~low])

    assert min(sizes(html.tree(), x)) >= 3
