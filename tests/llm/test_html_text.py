"""Template that stands inside the article, and articles that stand on many pages."""

import pytest

pytest.importorskip("walkloom.llm")
from walkloom.llm import html_text  # noqa: E402

PAGES = "page_id long, url string, html string"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, PAGES)).collect()}


def test_template_inside_article(spark):
    page = "<body><article><h1>Title {k}</h1><p>Own words of text {k}.</p><p>Sign up for our letter.</p><ul><li>Point {k}</li><li>Follow us</li></ul><h2>Read on</h2><table><tr><td>{k}</td></tr><tr><td>All rights reserved</td></tr></table></article></body>"
    got = texts(spark, [(k, "http://h/a", page.format(k=k)) for k in range(12)] + [(90, "http://other/a", page.format(k=90))])
    assert all(got[k] == f"Title {k} Own words of text {k}. Point {k} {k}" for k in range(12))
    assert got[90] == "Title 90 Own words of text 90. Sign up for our letter. Point 90 Follow us Read on 90 All rights reserved"


def test_article_on_many_pages(spark):
    same = "<body><nav>Place {k}</nav><article><h1>One title</h1><p>The same words everywhere.</p></article></body>"
    rows = [(k, "http://h/a", same.format(k=k)) for k in range(8)] + [(k, "http://h/b", f"<body><article><p>Own {k}</p></article></body>") for k in range(20, 24)]
    got = texts(spark, rows)
    assert got[0] == got[7] == "One title The same words everywhere." and got[20] == "Own 20"


def test_shapes_decide_without_lists(spark):
    page = "<html><body><div class='top'><a href='/{k}'>Go {k}</a><a>More {k}</a></div><div class=body><p>Own words {k} of a text that is long enough to be the core.</p><p>And {k} more.</p></div><div id=low><b>Low {k}</b></div></body></html>"
    rows = [(k, "http://h/a", page.format(k=k)) for k in range(12)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, PAGES), lists=False).collect()}
    assert all(got[k] == f"Own words {k} of a text that is long enough to be the core. And {k} more." for k in range(12))


def test_long_and_broken_pages():
    import time

    start = time.time()
    for page in ("<a " * 60_000, "<a href='" * 40_000, "<div>" * 50_000 + "</b>" * 50_000, "<b>" + "<i>" * 50_000 + "<hr>" * 50_000, "<!--" * 50_000, "<p>" * 50_000, "<script>" * 30_000, "&amp;" * 100_000, "<" * 200_000):
        blocks, known = html_text.parse(page)
        html_text.trees(blocks, known)
    assert time.time() - start < 60


def by_hand(page):
    """Text of the article of a page of the given table, by plain replacements."""
    import html
    import re

    page = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", page or "")
    inner = " ".join(re.findall(r"(?s)<article[^>]*>(.*?)</article>", page))
    inner = re.sub(r"<(/?)(h[1-6]|p|br|li|ul|td|tr|table|div|blockquote|section|pre)\b[^>]*>", "\0", inner)
    return " ".join(x for x in (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in inner.split("\0")) if x)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r["page_id"]: by_hand(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r for r in html_text.main_text(pages).collect()}
    assert len(got) == len(want) and all(got[k]["text"] == want[k] for k in want)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (None, "http://h/a", "<p>a", "y"), (1, "http://h/a", "", "z"), (2, "no url", "plain &lt;b&gt; text", None)]
    got = sorted((r["page_id"] or 0, r["text"]) for r in html_text.main_text(spark.createDataFrame(rows, f"{PAGES}, text string")).collect())
    assert got == [(0, "a"), (1, ""), (1, ""), (2, "plain <b> text")]
    assert html_text.main_text(spark.createDataFrame([], PAGES)).count() == 0
