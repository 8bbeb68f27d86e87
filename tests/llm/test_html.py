"""Extraction on hand-made pages, and the cut against all labellings."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from phrasemill.llm.html import blocks, extract, main_text, min_cut
from phrasemill.llm.queries import op4_html_extraction

SF = "/root/testdata/sf0.001"


def cost(labels, gains, ties):
    total = sum(-g if x and g < 0 else g if not x and g > 0 else 0 for x, g in zip(labels, gains, strict=True))
    return total + sum(w for a, b, w in ties if labels[a] != labels[b])


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randrange(1, 9)
        gains = [rng.uniform(-2, 2) for _ in range(n)]
        ties = [(a, b, rng.uniform(0, 1.5)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        got = cost(min_cut(gains, ties), gains, ties)
        assert got == pytest.approx(min(cost(x, gains, ties) for x in itertools.product((False, True), repeat=n)))


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>"</script></head>
    <body class="with-sidebar"><div id="cookie-notice"><p>We use cookies. Accept them all.</p></div>
    <header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a><li><a href=/b>News</a></ul></nav>
    <!-- <p>hidden</p> --><div class="container"><main><article>
    <header><h1>A title &amp; more</h1></header>
    <p>First   para&shy;graph, with <b>bold</b> and <a href="#">a link</a>.<br><p>Second&nbsp;one,
    5 &lt; 6.
    <ul><li>One item of it<li>Another item</ul><aside>Related stories here.</aside>
    <div class="ad-slot">Buy this. Now.</div><blockquote>Quoted words, and more of them.</blockquote>
    <form><label>Mail</label><input><button>Send</button></form><table><tr><td>a<td>b</table>
    </article><section class="comments"><h3>Comments</h3><p>Nice article, I liked it very much indeed.</p></section></main></div>
    <footer>&copy; 2020 <p>All rights reserved. Contact us.</p></footer></body></html>"""
    assert main_text(page).split("\n") == [
        "A title & more", "First para\xadgraph, with bold and a link.", "Second one, 5 < 6.", "One item of it",
        "Another item", "Quoted words, and more of them.", "a", "b"]


def test_page_without_semantic_tags():
    body = "".join(f"<p>This is sentence number {i} of the text, and it goes on for a while.</p>" for i in range(5))
    page = f"<body><div><a href=1>Home</a> <a href=2>About</a></div><div>{body}<p>Short.</p></div><div><a href=3>Imprint</a></div>"
    assert main_text(page).split("\n") == [re.sub("<.*?>", "", p) for p in body.split("</p>")[:-1]] + ["Short."]


def test_names_of_elements():
    page = """<div class="layout has-sidebar no-ads"><article class="post has-comments"><div class="post-header"><h1>Title here</h1></div>
    <p>The text of it, long enough to be read.</p><div class="shareBar">Share this now, please do.</div></article>
    <div id="responses"><article class="comment"><p>I liked it very much, thank you for it.</p></article></div>
    <article class="related-card"><p>Another story that is told elsewhere on the site.</p></article>
    <div class="SideBar">Most read stories of the week, all of them.</div></div>"""
    assert main_text(page).split("\n") == ["Title here", "The text of it, long enough to be read."]


def test_table(spark):
    rows = {r.page_id: r for r in op4_html_extraction(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        inside = re.search("<article>(.*)</article>", p.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", inside)
        want = [b.text for b in blocks("".join(f"<p>{x}</p>" for x in parts))]
        got = rows[p.page_id]
        assert got.text.split("\n") == want and got.n_chars == len(got.text) and got.url == p.url


def test_edges(spark):
    odd = [None, "", "   ", "plain text, no tags at all. It is long enough to be kept.", "<", "<p", "a < b and c > d, as they say here.",
           "<script>never closed", "<p>" * 3000 + "Deep text that stays. It is long.", "<!-- open", "<div><div></p></div>",
           "<nav>" + "<li>x" * 2000, "<p>" + "long text. " * 100_000]
    df = spark.createDataFrame([(i, h, "u", 1) for i, h in enumerate(odd)], "page_id int, html string, text string, n_chars int")
    out = extract(df)
    assert out.columns == ["page_id", "text", "n_chars"]
    by = {r.page_id: r.text for r in out.collect()}
    assert by[0] == by[1] == by[2] == by[5] == by[7] == by[9] == by[10] == by[11] == ""
    assert by[3] == odd[3] and by[6] == odd[6] and by[8].startswith("Deep") and len(by[12]) == 1_100_000 - 1
    assert extract(df.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "layout-sidebar-right", "main-with-sidebar", "page-search"])
@pytest.mark.parametrize("inner", ["main", "article", "div"])
def test_names_of_wrappers(name, inner):
    text = "The text of it, which is long enough to be read and goes on for some more words until it ends."
    page = f"""<body><div class="{name}"><{inner}><h1>Title here</h1><p>{text}</p><p>{text}</p></{inner}>
    <div class="sidebar"><p>Most read stories.</p></div></div><div class="footer">Imprint and contact.</div></body>"""
    assert main_text(page).split("\n") == ["Title here", text, text]


def test_comments_longer_than_the_article():
    text = "The text of it, which is long enough to be read."
    comment = "I liked it very much, thank you for it, and I have many more words to say about all of this. " * 3
    page = f"""<article><p>{text}</p></article><div class="comments"><p>{comment}</p><p>{comment}</p></div>"""
    assert main_text(page) == text


LINE = "This is a long sentence with quite a few words in it, so that it looks like real text of an article."


def page(body):
    return f"<html><body><nav>Home</nav>{body}<footer>Imprint</footer></body></html>"


@pytest.mark.parametrize("inner", [
    f"<div class='ad'>{LINE} Buy now.</div>", f"<p class='comment'>{LINE} I say.</p>", f"<div class=notice>{LINE}</div>",
    f"<aside class=x>{LINE}</aside>", f"<div id='related-posts'><p>{LINE}</p><p>{LINE}</p></div>", f"<div class='newsletter-box'>{LINE}</div>",
    "<section class='comments'><h2>Comments</h2>" + "".join(f"<p>{LINE * 4} {k}</p>" for k in range(3)) + "</section>",
    "<div class='comment-list'>" + "".join(f"<article class='comment'><p>{LINE * 4} {k}</p></article>" for k in range(3)) + "</div>",
])
def test_named_parts_of_an_article_are_left_out(inner):
    assert main_text(page(f"<article><p>{LINE}</p>{inner}<p>{LINE} End.</p></article>")) == f"{LINE}\n{LINE} End."


@pytest.mark.parametrize("body", [
    f"<div class='related-wrap'><article><p>{LINE}</p><p>{LINE}</p></article></div>",
    f"<article class='post'><div class='promo-layout'><p>{LINE}</p><p>{LINE}</p></div></article>",
    f"<article><section class=discussion><p>{LINE}</p><p>{LINE}</p></section></article>",
    f"<article><div class='has-comments'><p>{LINE}</p><p>{LINE}</p></div></article>",
    f"<article class=thread><div class='comments'><p>{LINE}</p><p>{LINE}</p></div></article>",
])
def test_names_of_wrappers_do_not_take_the_text(body):
    assert main_text(page(body)) == f"{LINE}\n{LINE}"


def test_odd_markup_loses_no_text():
    assert main_text(page(f"<article><p>{LINE} So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p><svg><path d='1'><p>{LINE}</p></article>")) == (
        f"{LINE} So x=1.\n{LINE}")
    assert main_text(page(f"<article><p title=dog's>{LINE}</p><img alt='it's'><p>{LINE}</p></article>")) == f"{LINE}\n{LINE}"
    assert main_text(page(f"<article><p title=\"a > b\" data-x='>'>{LINE}</p></article>")) == LINE


def test_deep_and_repeated_elements_are_read_in_linear_time():
    import time

    for text in ("<div>" * 20_000 + f"<p>{LINE}</p>" + "</div>" * 20_000, "<svg/>" * 20_000 + f"<p>{LINE}</p>", "<svg>" * 20_000 + f"<p>{LINE}</p>"):
        begin = time.process_time()
        assert main_text(f"<main>{text}</main>") == LINE
        assert time.process_time() - begin < 2
