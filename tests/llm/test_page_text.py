import html
import re
from pathlib import Path

import pytest

from tracewell.llm.page_text import main_text

SCHEMA = "page_id long, url string, html string, host string, text int"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], SCHEMA).repartition(3)
    return {r.page_id: r for r in main_text(df).collect()}


def test_article_without_the_rest(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h2>Site</h2></header><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
    <article class=post><header><h1>A &amp; B</h1></header><p><b>Bold  one.<br><p>Two&nbsp;&nbsp;words <em>in</em>side<br>here.</p>
    <ul><li>x<li>y</ul><aside>no</aside><form>f</form><div class="share-box">s</div><blockquote>q &lt;i&gt;</blockquote><p> </p>
    <section id="comments"><article><p>reader</p></article></section></article><div class="sidebar">side</div>
    <footer>&copy; x</footer></body></html>"""
    got = run(spark, [(1, "http://a.example/1", page), (2, None, None), (3, "x", ""), (4, "http://b", "just text &am; &amp"), (5, "http://b", "<p>cut <b"), (1, "http://a.example/1", page)])
    assert got[1].text == "A & B\n\nBold one.\n\nTwo words inside here.\n\nx\n\ny\n\nq <i>"
    assert got[1].n_chars == len(got[1].text) and got[1].url == "http://a.example/1"
    assert (got[2].text, got[2].n_chars, got[3].text) == ("", 0, "")
    assert got[4].text == "just text &am; &" and got[5].text.startswith("cut")


def test_template_of_a_host_without_article_elements(spark):
    rows = []
    for i in range(12):
        body = f"<div class='top'>Welcome to us</div><div class='box'><p>Story {i} has words {i * 7}.</p><p>More of {i}, a second part of it.</p></div><div class='low'>All rights kept</div>"
        rows.append((i, f"https://www.shop.example/{i}", f"<html><body>{body}</body></html>"))
    got = run(spark, rows)
    for i in range(12):
        assert got[i].text == f"Story {i} has words {i * 7}.\n\nMore of {i}, a second part of it."


def test_template_inside_articles(spark):
    rows, story = [], lambda i: f"Story {i} has words {i * 7}, and more of {i} is told in a second part of it."
    for i in range(12):  # boilerplate under neutral names, before and after the slots
        article = f"<p>Welcome to our daily page</p><div class='box'><p>{story(i)}</p></div><p>All that is here was told by us.</p>"
        rows.append((i, f"https://www.shop.example/{i}", f"<html><body><p>Top</p><article>{article}</article></body></html>"))
    parts = [f"Part {j} of one long article, which is told at some length {'and on ' * j}." for j in range(6)]
    whole = "".join(f"<p>{p}</p>" for p in parts)
    for i in range(4):  # copies of one article are no template
        rows.append((100 + i, f"https://copies.example/{i}", f"<html><body><p>Top</p><article>{whole}</article></body></html>"))
        rows.append((200 + i, f"https://near.example/{i}", f"<html><body><p>Top</p><article>{whole}<p>Line {i}.</p></article></body></html>"))
    got = run(spark, rows)
    for i in range(12):
        assert got[i].text == story(i) and got[i].n_chars == len(story(i))
    for i in range(4):
        assert got[100 + i].text == "\n\n".join(parts)
        assert got[200 + i].text == "\n\n".join([*parts, f"Line {i}."])


def test_article_parts_with_ordinary_words_and_unclosed_elements(spark):
    page = """<body><article><h2 id='social-impact'>Impact</h2><section id='related-work'><p>Work</p></section><p id='search-method'>Method</p>
    <p class='notice'>Note</p><svg class=i /><p>After svg</p><svg><text>no</text></svg><button>no</button><p>Then</p><button><p>After button</p><canvas><p>End</p></article></body>"""
    got = run(spark, [(1, "http://a.example/1", page), (2, "http://b.example/1", "<body><h2 id='social-impact'>Impact</h2><p>Text</p></body>")])
    assert got[1].text == "Impact\n\nWork\n\nMethod\n\nNote\n\nAfter svg\n\nThen\n\nAfter button\n\nEnd"
    assert got[2].text == "Impact\n\nText"
    # a box that the host's template has is no part of the article
    story = lambda i: f"Story {i} is told here in {i * 7} words or more than that."
    rows = [(i, f"http://c.example/{i}", f"<body><article><p>{story(i)}</p><div class='related'><p>See story {i * 3}</p></div></article></body>") for i in range(6)]
    assert all(r.text == story(i) for i, r in run(spark, rows).items())


def test_class_words_above_an_article_do_not_lose_it(spark):
    wrap = ["<body class='no-sidebar'>{}</body>", "<html class='ads menu'><body>{}</body></html>", "<body><div class='search-results'>{}</div></body>", "<body><div class='modal-open'><div id='banner'>{}</div></div></body>"]
    rows = [(i, f"http://a{i}.example/", w.format("<nav>n</nav><article><h1>Head</h1><p>Text of it</p><div class='ad'>Buy</div></article>")) for i, w in enumerate(wrap)]
    rows.append((10, "http://b.example/", "<body><div class='related'><article><p>Another story</p></article></div><article><p>This story</p></article></body>"))
    rows.append((11, "http://c.example/", "<body><p>Text</p><div class='comments'><article><p>reader</p></article></div></body>"))
    rows.append((12, "http://d.example/", "<body class='sidebar'><main><p>Text of main</p><div class='sidebar'>side</div></main></body>"))
    rows.append((13, "http://e.example/", "<body><aside><article><p>Aside</p></article></aside><div class='promo'>Buy</div><p>Plain</p></body>"))
    got = {i: r.text for i, r in run(spark, rows).items()}
    assert got == {**dict.fromkeys(range(4), "Head\n\nText of it"), 10: "This story", 11: "Text", 12: "Text of main", 13: "Plain"}


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="tables are not here")
def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_empty(spark):
    assert main_text(spark.createDataFrame([], SCHEMA)).collect() == []
