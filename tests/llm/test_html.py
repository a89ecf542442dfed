import re
import time
from html import unescape

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymark.llm.html_extract import extract, main_text
from tests.llm.conftest import SF, needs_data

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home, start, all</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, many of them, all the time.</p></div>
<!-- <p>old</p> --><div id="content"><h1>Title &amp; more</h1><p>First, <b>bold<br>text</b> here.<p>Second
  line&#33;<script>var x = "</p>";</script></p><ul><li>one<li>two</ul><form><p>Name, mail, text</p></form>
<div class="ad">Buy, buy, buy</div></div>
<div class="sidebar"><p>Side, side, side, side, side.</p></div>
<div id="comments"><p>Nice, very, very, very, very nice post, indeed.</p></div><footer><p>Imprint</p></footer></body></html>"""


def test_only_the_article_is_kept():
    assert main_text(PAGE) == "Title & more\n\nFirst, bold text here.\n\nSecond line!\n\none\n\ntwo"


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain", "plain"), ("<p>a &lt; b&nbsp;c<p>d", "a < b c\n\nd"),
    ("<article><h1>t</h1></article>", "t"), ("<p title='a>b' x=\"1>q</p>", "q"), ("<!-- open", ""), ("a < b <i>c</i>", "a < b c"),
    ("<article><section><p>A.</p></section><section><p>B.</p></section><div class=comments><p>C.</p></div></article>", "A.\n\nB."),
    ("<ul><li><a>l1</a><li><a>l2</a></ul><div><p>Text, here.</p></div>", "Text, here."),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<div hidden>x</div><div>y</div>", "y"),
])
def test_cases(source, text):
    assert main_text(source) == text


BODY = "".join(f"<p>Sentence {i} of the article, which is long enough, says this and that.</p>" for i in range(12))
MENU = "<nav><a href='/'>Home</a></nav><div class='sidebar'><p>Side, side, side.</p></div><div class='cookie-notice'>We use cookies, many.</div>"


@pytest.mark.parametrize("wrapper", [
    "<div class='overflow-hidden'>{}</div>", "<div class='content has-sidebar'>{}</div>", "<article class='post has-comments'>{}</article>",
    "<div id='social-history'>{}</div>", "<form id='page'>{}</form>", "<div class='widget'><div class='modal'>{}</div></div>",
    "<form><div class='no-sidebar'><h1>T</h1>{}</div></form>", "<div class='discussion'>{}</div>", "<div role=form>{}</div>",
])
def test_a_wrapper_with_an_odd_name_does_not_lose_the_article(wrapper):
    inner = BODY + "<div class='ad'>Buy, buy</div><div class='related-posts'><a>Other, more</a></div>"
    want = "\n\n".join(re.findall("<p>(.*?)</p>", BODY))
    assert main_text(f"<body>{MENU}{wrapper.format(inner)}</body>").removeprefix("T\n\n") == want


def test_a_named_part_of_an_article_stays_and_boxes_go():
    part = "<section id='social-history'><p>Its social history, in short.</p></section>"
    share = "<div class='share-price-links'><a>Share, here</a> or</div>"
    got = main_text(f"<article><h1>T</h1>{BODY}{part}{share}<div id='comments'><article>{BODY * 5}</article></div></article>")
    assert got.endswith("\n\nIts social history, in short.") and got.count("Sentence 3 ") == 1
    # A short article stays alone beside large boxes.
    assert main_text(f"<h1>T</h1><p>Short, it is.</p><div class='cookie-notice'>{BODY}</div><div id=comments>{BODY}</div>") == "T\n\nShort, it is."


def test_paragraphs_in_containers_of_their_own_all_stay():
    divs = ["Short one.", "A long one, with commas, many of them, and more, and words, words, words, to the end.", "Another short one.", "Third."]
    page = "<div class=nav-menu><a href=x>Home</a></div><div id=w>" + "".join(f"<div><p>{d}</p></div>" for d in divs) + "<div><p><a href=y>More of this here</a></p></div></div>"
    assert main_text(page) == "\n\n".join(divs)


def test_the_header_of_main_goes_if_there_is_an_article():
    words = "Some words, and more of them, say this and that. " * 9
    rest = f"<header><h1>Title</h1></header><p>{words}</p>"
    assert main_text(f"<main><header><p>The Daily Site, since 1900</p></header><article>{rest}</article></main>") == f"Title\n\n{words.strip()}"
    assert main_text(f"<main>{rest}</main>") == f"Title\n\n{words.strip()}"


def test_a_long_article_without_marks_is_read_whatever_is_left_outside():
    left = "Some words, left outside of the form, that are neither few nor many. " * 5
    page = f"<p>{left}</p><form><div>{''.join(f'<p>Paragraph {i}, with words, and more, and more</p>' for i in range(99))}</div></form>"
    assert "Paragraph 39" in main_text(page)


def test_elements_that_are_never_closed_cost_no_more():
    n = 100_000
    for page in ("<font>" * n + "<p>a, b" * n, "<font>" * n + "</b>" * n + "x", "<b><p>" + "<i>" * n + "</b>" * n + "x", "<form>" * n + "<dt>a<li>b" * n):
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 12


def test_long_and_deep_pages_stay_linear():
    assert main_text("<div>" * 30_000 + "x") == "x"
    assert main_text("<p>x, y</p>" * 30_000).count("x, y") == 30_000


def test_table_form_keeps_columns_and_rows(spark):
    rows = [(1, "u", "<p>a</p>", "old"), (1, "u", "<p>a</p>", "old"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "u", "a"), (1, "u", "a"), (None, None, "")]
    assert extract(pages.limit(0)).count() == 0


@needs_data
def test_query_equals_a_plain_reading_of_the_driver_pages(spark):
    from tallymark.llm.queries import QUERIES

    pages = pd.read_parquet(f"{SF}/pages.parquet")
    plain = {}
    for page_id, source in zip(pages["page_id"], pages["html"]):
        body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = [unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:p|h1)>", body)]
        plain[page_id] = "\n\n".join(" ".join(b.split()) for b in blocks if b.strip())
    got = QUERIES["op1_html_extraction"](spark, SF)
    assert {r["page_id"]: r["text"] for r in got.collect()} == plain
    assert got.where(F.col("n_chars") != F.char_length("text")).count() == 0
