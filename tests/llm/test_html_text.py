import html
import random
import re

from recordlens.llm import html_text, queries
from tests.llm.conftest import SF

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x}</style></head><body>
<header class="site"><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li>
<li><a>News</a></li></ul></nav><div class="cookie-notice">We use cookies here, many of them</div>
<main><article><header><h1>The  title</h1></header>
<p>First &amp; <b>bold</b> paragraph with a good number of words in it, as articles have.
<p>Second paragraph, unclosed before it, <!-- hidden > --> with&nbsp;space and more words.</p>
<aside class="sidebar"><p>Related reading in the sidebar</p></aside>
<form action="/s"><p>Sign up for our letter</p><input name=x></form>
<div class="ad">Buy this now</div><script>var a = "<p>not text</p>";</script>
<ul><li>A list item with some words</li><li>Another item of it</li></ul>
<p>Line<br>break and the end of the text, which is long enough to be kept whole.</p>
<section id="comments"><p>A reader says something rather long here, more than a few words</p>
</section></article></main><footer><p>&copy; the site and its owners</p></footer></body></html>"""
TEXT = """The title
First & bold paragraph with a good number of words in it, as articles have.
Second paragraph, unclosed before it, with space and more words.
A list item with some words
Another item of it
Line break and the end of the text, which is long enough to be kept whole."""


def article(page):
    inner = page[page.index("<article>") + 9:page.index("</article>")]
    blocks = (re.sub(r"<[^>]*>", "", p) for p in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_query_against_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = queries.op10_main_text(spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r.text == article(pages[r.page_id].html)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


def test_clutter_goes(spark):
    weights = html_text.fit_weights(spark.createDataFrame([(PAGE,)], "html string"))
    assert weights[""] > 0 and all(w < 0 for tag, w in weights.items() if tag)
    assert weights["p"] > weights["nav"]
    assert html_text.main_text(PAGE, weights) == TEXT


def test_pages_without_labels_or_text(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain words &lt;b&gt; only"), (4, "u", "<p"),
            (5, "u", "<nav>menu</nav>"), (5, "u", "<p>one</p><p>two</p>" * 3), (6, "u", "<!-- open"),
            (7, "u", "<script>x"), (8, "u", "<div>" * 20_000 + "deep" + "</div>" * 5), (9, "u", "a < b")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows],
                                  "page_id long, url string, html string, text string")
    found = {(r.page_id, r.text) for r in html_text.extract(pages).collect()}
    assert (1, "") in found and (2, "") in found and (4, "") in found and (6, "") in found
    assert (None, "plain words <b> only") in found and (5, "") in found and (7, "") in found
    assert (9, "a < b") in found
    assert html_text.extract(pages.limit(0)).count() == 0


ARTICLE = "".join(f"<p>Paragraph number {i} of the article with quite a few words in it.</p>"
                  for i in range(6))
LINES = "\n".join(f"Paragraph number {i} of the article with quite a few words in it."
                  for i in range(6))
MENU = "<ul>" + "<li><a href='/'>Entry</a></li>" * 8 + "</ul>"


def found(spark, body):
    weights = html_text.fit_weights(spark.read.parquet(f"{SF}/pages.parquet"))
    return html_text.main_text(f"<html><body><nav>{MENU}</nav>{body}<footer>The end of the site"
                               "</footer></body></html>", weights)


def test_marks_yield_to_the_article(spark):
    for around in ('<div class="post comments-open">{}</div>',
                   '<div class="layout has-sidebar"><article>{}</article></div>',
                   '<form id="aspnetForm">{}</form>', '<form id="f"><article>{}</article></form>',
                   '<div class="widget"><main>{}</main></div>', '<div id="social">{}</div>',
                   "<section class='related-price'>{}</section>"):
        assert found(spark, around.format(ARTICLE)) == LINES, around


def test_a_section_of_the_article_with_an_unlucky_name(spark):
    inner = f"<p>Opening words of it.</p><section class='share-price-history'>{ARTICLE}</section>"
    assert found(spark, f"<article>{inner}</article>") == f"Opening words of it.\n{LINES}"


def test_nothing_of_the_article_is_dropped(spark):
    rows = "".join(f"<tr><td>{i}</td><td>x</td></tr>" for i in range(20))
    items = "".join(f"<li>w{i}</li>" for i in range(30))
    end = f"<table>{rows}</table><ul>{items}</ul><p>End.</p>"
    text = "\n".join([LINES, *(t for i in range(20) for t in (str(i), "x")),
                      *(f"w{i}" for i in range(30)), "End."])
    assert found(spark, f"<article>{ARTICLE}{end}</article>") == text
    assert found(spark, f"<div class='story'>{ARTICLE * 6}{end}</div>") == \
        "\n".join([LINES] * 6) + text[len(LINES):]


def test_asides_still_go(spark):
    clutter = [
        '<div class="comments"><p>A reader says a thing or two about it here.</p></div>',
        '<aside><article>Teaser of some other article.</article></aside>',
        '<div class="cookie-notice">We use cookies.</div>', '<div id="sidebar-left">Left</div>',
        '<div class="siteFooter">Foot</div>', '<p class="ad-1">Buy</p>', "<form>Mail us</form>",
        '<div style="display: none">Hidden</div>']
    for one in clutter:
        assert found(spark, f"<article>{ARTICLE}{one}</article>") == LINES, one
        assert found(spark, f"{one}<article>{ARTICLE}</article>{one}") == LINES, one


def test_scan_against_all_regions():
    pick = random.Random(3)
    for _ in range(300):
        values = [pick.choice([-8, -3, -1, 0, 1, 2, 5]) for _ in range(pick.randint(0, 25))]
        first, end = html_text.best_region(values)
        best = max((sum(values[i:j]) for i in range(len(values))
                    for j in range(i + 1, len(values) + 1)), default=0)
        assert sum(values[first:end]) == max(best, 0)


def test_long_and_deep_pages():
    weights = {"": 1.0, "p": -0.1}
    page = "<div class=ad>" * 3000 + "<p>some words here</p>" * 3000
    assert html_text.main_text(page, weights).count("some words here") == 3000
    assert html_text.main_text("<b>" * 50_000 + "word", weights) == "word"
