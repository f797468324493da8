import html
import re

import pytest
from pyspark.sql import functions as F

from opslens.llm import html_text

SF = "/root/testdata/sf0.001"
LONG = "The quick brown fox jumps over the lazy dog and then it runs away from the house with all of the food that was there. "
PAGE = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{x}}</style></head><body><header class="site"><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></ul></nav><div id="cookie-notice">We use cookies</div><div class="adBox">Buy</div>
<article class="post"><header><h1>A title</h1></header><p>{LONG} <b>bo</b>ld &lt;tag&gt; &amp;amp;&nbsp;x<br>y<p>Short one.
<div class="ad-slot">Buy now</div><script>var a="</p><p>no";</script><ul><li>First<li>Second <i>item</i></ul>
<p>See <a href="x">{LONG}</a> and more of it that is not a link but plain text<!-- <p>not this -->
<aside>Side</aside><form><label>Mail</label><input></form><section id="comments"><article class="comment"><p>{LONG}</article></section></article>
<div class=sidebar>{LONG}</div><footer>&copy; us</footer></body></html>"""


def test_article_page():
    assert html_text.main_text(PAGE).split("\n\n") == [
        "A title", LONG + "bold <tag> &amp; x y", "Short one.", "First", "Second item", f"See {LONG}and more of it that is not a link but plain text"]


def test_page_without_article():
    page = f"<div class=menu><a href=1>One</a></div><div><p>{LONG * 2}</p><p>Tiny.</p><p>{LONG * 2}</p></div><div><a href=a>Link one</a> <a href=b>link two</a></div><p>© 2020 all of the rights are with the owner</p>"
    assert html_text.main_text(page) == "\n\n".join([(LONG * 2).strip(), "Tiny.", (LONG * 2).strip()])


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("plain <3 text", "plain <3 text"), ("<p>a", "a"), ("</p></div>x</b>", "x"), ("<p>1 &lt; 2 &#65;&#x42; &bogus; &amp;lt;", "1 < 2 AB &bogus; &lt;"),
    ('<p title="a>b">x</p>', "x"), ("<p title=\"open>x</p>", "x"), ("<script>never closed", ""), ("<!-- never closed", ""), ("<p>a<wbr>b<img src=x>c</p>", "abc"), ("<article></article>", ""),
    ("<article><p>Be.</p></article><p>outside text</p>", "Be."), ("<article><h1>T</h1><p hidden>x</p><p style='display: none'>y</p></article>", "T"),
])
def test_pages_of_every_kind(page, text):
    assert html_text.main_text(page) == text


BODY = [LONG * 2, "A short one.", LONG * 3]
TEXT = "\n\n".join(b.strip() for b in BODY)
INSIDE = "".join(f"<p>{b}</p>" for b in BODY)
SIDE = f"<p>{LONG}</p>"
LAYOUTS = {
    "a class that only mentions a sidebar": f'<div class="content has-sidebar"><article>{INSIDE}</article></div><div class="left-sidebar">{SIDE}</div>',
    "a form round the page": f'<form id="aspnetForm"><nav><a href=x>Home</a></nav><article>{INSIDE}</article><div class="sidebar">{SIDE}</div></form>',
    "a form round a page without article": f'<form id="aspnetForm"><div class="menu"><a href=x>Home</a></div><div>{INSIDE}</div></form>',
    "widgets mentioned": f'<div class="layout with-widgets"><main>{INSIDE}</main></div>',
    "sharing mentioned": f'<div class="post share-enabled">{INSIDE}</div><div class="share-buttons"><p>Share this with all of your friends on the net</p></div>',
    "a fixed header mentioned": f'<div id="page-header-fixed-layout"><article>{INSIDE}</article></div>',
    "a teaser article inside main": f'<main>{INSIDE}<article class="teaser"><p>Read on</p></article></main>',
    "teasers beside the text": f'<div>{INSIDE}</div><div class="related-posts"><article>{SIDE}</article></div><footer>{SIDE}</footer>',
    "an article below a sidebar name": f'<div class="widget-area"><article>{INSIDE}</article></div><div><a href=a>More</a></div>',
    "long comments": f'<article>{INSIDE}</article><section id="comments">{"".join(f"<article><p>{LONG * 4}</p></article>" for _ in range(5))}</section>',
    "comments inside the article": f'<article>{INSIDE}<div class="comment-list"><p>{LONG * 9}</p></div></article>',
    "a banner, a cookie notice and a newsletter": f'<div class="top-banner">{SIDE}</div><div id="cookie-notice">{SIDE}</div><div>{INSIDE}</div><div class="newsletter-box"><p>Subscribe to it all now</p></div>',
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    got = html_text.main_text(f"<html><body>{LAYOUTS[layout]}</body></html>")
    assert got in (TEXT, TEXT + "\n\nRead on") if "teaser article" in layout else got == TEXT


def test_stop_words_links_and_neighbours_decide():
    """No container says anything here: each of the three rules is the only one that can."""
    no_stops = "Widget 4711 chrome steel brushed finish " * 8
    links = "".join(f"<a href={i}>{LONG}</a> " for i in range(3))
    page = f"<div><p>{LONG * 2}</p><p>Near good.</p><p>{LONG * 2}</p></div><div><p>{links}</p><p>Near bad.</p></div>"
    assert html_text.main_text(page).split("\n\n") == [(LONG * 2).strip(), "Near good.", (LONG * 2).strip()]
    blocks = [html_text.Block(text=no_stops), html_text.Block(text=LONG * 2)]
    assert [html_text.by_density(b) for b in blocks] == [None, True]


def test_second_pass_takes_the_nearest_label():
    Block = html_text.Block
    blocks = [Block(text=str(i)) for i in range(7)]
    assert html_text.second_pass(blocks, [True, None, None, None, False, None, None]) == [True, True, False, False, False, False, False]
    assert html_text.second_pass(blocks[:3], [None, None, None]) == [True] * 3


def test_query_finds_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    got = html_text.op6_html_text(spark, SF).toPandas().set_index("page_id")
    for i, page in zip(pages.page_id, pages.html):
        article = re.search("<article>(.*?)(</article>|<footer>|$)", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert got.loc[i].text == "\n\n".join(b for b in blocks if b) and got.loc[i].n_chars == len(got.loc[i].text)


def test_column_expression(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "<p>a</p>", "y"), (None, "<p>a</p>", "y"), (2, "<p>" + "word " * 100_000, "z")], "page_id LONG, html STRING, text STRING")
    got = [r["t"] for r in df.select(html_text.extracted(F.col("html")).alias("t")).collect()]
    assert got[:3] == ["", "a", "a"] and len(got[3]) == 499_999
    assert df.where("false").select(html_text.extracted(F.col("html"))).count() == 0
