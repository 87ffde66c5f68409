"""Title and text of web pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content isn't shown.
UNSEEN = frozenset(("script", "style", "noscript", "template", "head", "svg", "iframe", "object"))
#: Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A tag that the page's end cuts off is none.
_CUT_OFF = re.compile(r"<[a-zA-Z/!][^<>]*\Z")


class _Page(HTMLParser):
    """Collects a page's first title, its lines, and its link targets; references to characters are resolved."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.lines: list[list[str]] = [[]]
        self.links: list[str] = []
        self.unseen: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.unseen.clear()  # a head that isn't closed ends here
        if tag == "title" and self.title is None and "svg" not in self.unseen:
            self.title, self.in_title = "", True
        elif tag in UNSEEN:
            self.unseen.append(tag)
        elif tag in BLOCKS:
            self.lines.append([])
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v][:1]

    def handle_startendtag(self, tag, attrs):
        if tag not in UNSEEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in self.unseen:
            # what was opened inside and not closed ends with it
            del self.unseen[len(self.unseen) - 1 - self.unseen[::-1].index(tag) :]
        elif tag in BLOCKS:
            self.lines.append([])

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.unseen:
            self.lines[-1].append(data)


def read_page(html: str | None) -> tuple[str | None, str, list[str]]:
    """(title, text, links): the title's words, null if there is none; the shown lines, blanks being one space and empty lines gone; link targets in order.

    A null page has no text. Broken pages are read as far as they go: an element that isn't closed ends with the one around it, or with the page.
    """
    page = _Page()
    page.feed(_CUT_OFF.sub("", html or ""))
    page.close()
    lines = (" ".join("".join(line).split()) for line in page.lines)
    title = None if page.title is None else " ".join(page.title.split()) or None
    return title, "\n".join(line for line in lines if line), page.links


def page_text(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """page_id, title, text, links: a row for each row of pages; see read_page(). Other columns are ignored; an empty table gives no rows."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                read = [read_page(x.as_py()) for x in part["_html"]]
                columns = [pa.array([r[k] for r in read], t) for k, t in ((0, pa.string()), (1, pa.string()), (2, pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [part.schema.names[0], "title", "text", "links"])

    rows = pages.select(page_id, F.col(html).alias("_html"))
    new = [T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))]
    return rows.mapInArrow(run, T.StructType([rows.schema[page_id], *new]))
