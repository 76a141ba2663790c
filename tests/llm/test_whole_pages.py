"""Pages of any url as WARC, main texts under odd class names, and short paragraphs."""

import os
import time
from html.parser import HTMLParser

import duckdb
import pytest
from held import DATA

from frameloom.llm import op2_warc, op6_paragraphs, op9_html


def test_urls_of_any_scheme_keep_their_pages(spark, tmp_path):
    urls = ["ftp://h/x", "//host/x", "example.com/x", " http://a/b", "HTTP://up/", "mailto:a@b"]
    html = "HTTP/1.0 y " + "ü" * 1000
    rows = [(i, u, html) for i, u in enumerate(urls)] + [(None, "ftp://h/n", html), (None, "x", "short"), (9, "x y", None)]
    op2_warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    back = op2_warc.read_warc(spark, str(tmp_path / "w")).collect()
    n = len(html.encode())
    got = sorted((r.key if r.key is not None else -1, r.payload_bytes, r.record_type, r.refers_to or 0) for r in back)
    assert got == sorted([(i, n, "revisit", 5) for i in range(5)] + [(5, n, "response", 0), (-1, n, "revisit", 5), (-1, 5, "response", 0), (9, 0, "response", 0)])
    assert op2_warc.http_parts("ftp://h/x", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nx") == (b"", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nx")


def test_class_names_do_not_hide_the_article():
    p = "<p>A paragraph, with commas, and enough text to count for something here.</p>"
    text = "A paragraph, with commas, and enough text to count for something here."
    for name in ("layout has-sidebar", "content with-comments", "page-with-nav", "sidebar"):
        for inner in (f"<article>{p}</article>", f"<div>{p * 3}</div>"):
            assert text in op9_html.main_text(f"<body><div class='{name}'>{inner}</div></body>"), (name, inner)
    assert op9_html.main_text(f"<body><div class=post>{p}</div><div class=comments>{'<p>I, for one, disagree with this.</p>' * 9}</div></body>") == text
    page = f"<article><h2 class='section-header'>Head</h2>{p}<p class=byline>By me</p><div class='related-work'>Others</div><p class=tags>one two</p><figure><figcaption>Shown</figcaption></figure><ul><li><a href=1>Link one</a><li><a href=2>Link two</a></ul><div class='ad'>Buy</div></article>"
    assert op9_html.main_text(page) == f"Head {text} By me Others one two Shown Link one Link two"


def test_short_paragraphs_are_units(spark):
    texts = [(1, "All rights reserved by us\nfirst text"), (2, "second\nall rights reserved by us"), (3, "Read more\nthird"), (4, "read  more\nfourth one"), (5, "more read")]
    out = op6_paragraphs.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start, r.words, r.component_id, r.removed) for r in out} == {(1, 0, 5, 1, False), (2, 7, 5, 1, True), (3, 0, 2, 3, False), (4, 0, 2, 3, True)}


class Slow(HTMLParser):
    """The text of article elements, by the parser of the standard library."""

    def __init__(self, page):
        super().__init__()
        self.depth, self.parts = 0, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.parts.append("" if tag in op9_html.INLINE else " ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.parts.append("" if tag in op9_html.INLINE else " ")

    def handle_data(self, data):
        self.parts.append(data if self.depth else "")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_query_against_the_standard_parser(spark):
    pages = duckdb.sql(f"SELECT page_id, html FROM '{DATA}/pages.parquet'").fetchall()
    got = {r.page_id: (r.text, r.n_chars) for r in op9_html.op9_html(spark, DATA).collect()}
    want = {i: " ".join("".join(Slow(h or "").parts).split()) for i, h in pages}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_unbalanced_pages_take_time_in_proportion():
    body = "".join(f"<p>Paragraph {i}, with commas, and text enough to count.</p>" for i in range(20))
    for page in ("<div>" * 50_000 + "</span></b></li>" * 50_000, "<b>" * 50_000 + "<div></i>" * 50_000, "<ul><li>" * 50_000 + "</td>" * 50_000):
        began = time.monotonic()
        text = op9_html.main_text(f"<article>{body}</article>{page}")
        assert text.startswith("Paragraph 0,") and time.monotonic() - began < 10
