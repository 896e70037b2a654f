"""Main text of hand-made pages, and consensus over a host."""

from __future__ import annotations

import re

import pytest

from basketry.llm import html_extract

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="b7">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad-slot">Buy <p>now</p></div><aside>Side</aside><div class="post post-%d"><h1>Title &amp; more</h1>
<p>First <b>bold</b>&nbsp;text<br>after  break</p><form><label>Name</label><input name=x></form><p>Second &lt;p&gt; &#233;
line</p><ul><li>one<li>two</ul><!-- <p>hidden</p> --><div class="share">Share me</div></div>
<section id="comments"><div class="comment"><p>%s</p></div></section><footer>&copy; Site</footer></body></html>"""
TEXT = "Title & more\nFirst bold text after break\nSecond <p> é line\none\ntwo"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows],
                                 "page_id long, url string, html string, host string, paths string")


def test_article_without_the_rest():
    assert html_extract.extract(PAGE % (7, "I disagree " * 100), []) == TEXT


@pytest.mark.parametrize("html,text", [
    ("", ""), ("plain < 3 words", "plain < 3 words"), ("<p>a<p>b", "a\nb"), ("<div><p>a</div><div>b", "a\nb"),
    ("<article>x<script>y", "x"), ("<article><p>cut <b", "cut"), ("<p title='a>b'>q</p>", "q"), ("<!-- open <p>z", ""),
    ('<DIV CLASS="menu">m</DIV><TD Class="comments">c</TD><DIV ID="ad">a</DIV><div HIDDEN>h</div><P>v', "v"),
    ("<P>Ünï<SPAN>cödé</SPAN></P>", "Ünïcödé"), ("<div hidden>h</div><p>v</p>", "v"), ("</p></div><p>t", "t"),
    ("<table><tr><td>a<td>b</table>", "a\nb"), ("<p " + "a " * 1000, ""), ("<" * 2000, "<" * 2000), ("<div>" * 3000 + "deep", "deep"),
])
def test_lenient(html, text):
    assert html_extract.extract(html, []) == text


def test_host_consensus_wins_over_a_loud_block(spark):
    good = "<body><div class='story s%d'><p>Short article %d.</p></div><div class='blurb'><p>%s</p></div></body>"
    rows = [(i, f"http://News.example.com/{i}", good % (i, i, "tiny")) for i in range(20)]
    rows.append((50, "http://news.example.com:80/x", good % (50, 50, "a very loud block that is longer than the article")))
    rows += [(60, None, good % (60, 60, "t")), (61, "no host", good % (61, 61, "t")), (62, "http://h.example/", None), (63, "http://h.example/", ""),
             (None, "http://news.example.com/q", good % (7, 7, "t")), (3, "http://news.example.com/3", good % (3, 3, "tiny"))]
    for limit in (html_extract.BROADCAST_BYTES, -1):
        html_extract.BROADCAST_BYTES, kept = limit, html_extract.BROADCAST_BYTES
        try:
            got = html_extract.main_text(pages(spark, rows)).collect()
        finally:
            html_extract.BROADCAST_BYTES = kept
        assert len(got) == len(rows)
        by_id = {r.page_id: r for r in got}
        assert by_id[50].text == "Short article 50." and by_id[60].text == "Short article 60."
        assert by_id[62].text == by_id[63].text == "" and by_id[None].text == "Short article 7."
        assert all(r.n_chars == len(r.text) for r in got)


def test_two_templates_of_a_host_keep_their_articles(spark):
    one = "<body><div><p>%s</p></div></body>"
    two = "<body><main><article><p>%s</p></article></main><div>(c) Site</div></body>"
    story = "A long story of many words, told to its end. " * 5
    rows = [(i, f"http://two.example/{i}", (one if i < 12 else two) % f"{story}{i}") for i in range(20)]
    rows += [(50 + i, f"http://few.example/{i}", (one if i < 29 else two) % f"{story}{i}") for i in range(30)]
    got = {r.page_id: r.text for r in html_extract.main_text(pages(spark, rows)).collect()}
    assert got == {i: f"{story}{i if i < 50 else i - 50}" for i, _, _ in rows}


@pytest.mark.parametrize("wrap", ["%s", "<div class=wrap>%s</div>"])
def test_headline_and_lead_over_the_content(wrap):
    content = wrap % ("<div class=content><p>" + "Body text. " * 60 + "</p></div>")
    page = f"<body><div class=post><h1>Headline</h1><p>Lead</p>{content}</div><div class=other><p>Other</p></div></body>"
    want = "Headline\nLead\n" + ("Body text. " * 60).strip()
    inner = "body>div.post>div.wrap>div.content" if "wrap" in wrap else "body>div.post>div.content"
    assert html_extract.extract(page, []) == html_extract.extract(page, [inner]) == want


def test_empty(spark):
    assert html_extract.main_text(pages(spark, [])).collect() == []


ARTICLE = "<p>First paragraph of the article, long enough to be text.</p><p>Second paragraph with more words.</p><p>The third ends it.</p>"
PLAIN = "First paragraph of the article, long enough to be text.\nSecond paragraph with more words.\nThe third ends it."


@pytest.mark.parametrize("names", [
    "site right-sidebar", "content no-sidebar", "has-comments post", "search-result article", "ad-free story",
    "social-policy", "reply-all", "widget-area-none main"])
def test_no_word_in_an_outer_class_removes_the_article(names):
    for attr in ("class", "id"):
        page = (f'<html><body><nav><a href=x>Menu</a></nav><div id=page {attr}="{names}">{ARTICLE}<div class="sidebar"><p>Side words</p></div>'
                '<div class="ad-box">Buy this now</div><div class="comments"><p>Nice one</p></div></div><footer>c</footer></body></html>')
        assert html_extract.extract(page, []) == PLAIN


def test_form_around_the_page_and_header_in_the_article():
    form = f"<html><body><form id=aspnetForm><input name=q><select><option>one</option></select><div>{ARTICLE}</div></form></body></html>"
    assert html_extract.extract(form, []) == PLAIN
    header = f"<html><body><header><h1>Site</h1></header><article><header class=entry-header><h1>Headline</h1></header>{ARTICLE}</article></body></html>"
    assert html_extract.extract(header, []) == "Headline\n" + PLAIN
    beside = f"<html><body><div>{ARTICLE}</div><form class=login><p>Sign in to read on, it is free of charge</p></form></body></html>"
    assert html_extract.extract(beside, []) == PLAIN


def test_long_comments_go_and_nested_layouts_stay():
    many = "<p>A reader has a lot to say about all of this.</p>" * 300
    page = f"<html><body><div class=post>{ARTICLE}</div><div class=comments>{many}</div></body></html>"
    assert html_extract.extract(page, []) == PLAIN
    nested = (f'<html><body><div class="layout sidebar-left"><div class="col-menu-3"><a href=a>One</a> <a href=b>Two</a></div>'
              f'<div class="content comments-open"><div class="text">{ARTICLE}</div><div id=comments>{many}</div></div></div></body></html>')
    assert html_extract.extract(nested, []) == PLAIN


def test_given_pages_equal_the_documents_they_were_made_from(spark):
    """Pages whose path ends in the number of a document hold its text under a headline."""
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    checked = 0
    for r in html_extract.main_text(spark.read.parquet(f"{folder}/pages.parquet")).collect():
        number = re.search(r"/(\d+)(?:/|\.html)?(?:[?#].*)?$", r.url or "")
        doc = " ".join(texts.get(int(number[1]), "").split()) if number else ""
        if doc and doc[:20] == " ".join(r.text.split())[:20]:
            checked += 1
            assert " ".join(r.text.split("\n", 1)[1].split()) == doc, r.url
    assert checked >= 100, checked


def test_a_page_of_megabytes_with_many_doubtful_elements():
    page = "<html><body><div class='site no-sidebar'>" + "<div class='comment-item'><p>word word word word</p></div>" * 40_000 + f"<div>{ARTICLE}</div></div></body></html>"
    assert "First paragraph" in html_extract.extract(page, [])
