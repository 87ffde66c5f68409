"""Anchors of questions, sentences, chunks, mentions and readers of notes and feeds, against stated cases and plain Python."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from siltstone.operators import notes
from siltstone.sources import files

TODAY = datetime.date(2026, 5, 15)


@pytest.mark.parametrize(
    ("text", "tickers", "kinds", "since"),
    [
        ("AAPL earnings", ["AAPL"], ["filing"], None), ("USA GDP growth", [], [], None), ("compare MSFT vs AAPL vs MSFT", ["MSFT", "AAPL"], [], None), ("aapl earnings", [], ["filing"], None),
        ("books last week", [], ["book", "book_chapter"], datetime.date(2026, 5, 1)), ("the 10-K of AAPL", ["AAPL"], ["filing"], None), ("May 2026", [], [], datetime.date(2026, 5, 1)),
        ("sept 2024 yesterday", [], [], datetime.date(2024, 9, 1)), ("December 2023", [], [], datetime.date(2023, 12, 1)), ("2026", [], [], datetime.date(2026, 1, 1)), ("notebook", [], [], None), ("", [], [], None), (None, [], [], None),
    ],
)
def test_anchors(spark, text, tickers, kinds, since):
    df = spark.createDataFrame([(text,)], "t string")
    a = df.select(notes.anchors(F.col("t"), ("AAPL", "MSFT"), F.lit(TODAY)).alias("a")).first().a
    assert (a.tickers, a.kinds, a.since) == (tickers, kinds, since)


def test_words_left_and_predicate(spark):
    a = notes.anchors(F.lit("AAPL margin trends in filings this month"), ("AAPL",), F.lit(TODAY))
    rows = [("Filings/AAPL/q1.md", "filing", TODAY, True), ("Filings/AAPL/q1.md", "note", TODAY, False), ("Research/2026-05-01-aapl-x.md", "filing", None, True),
            ("Filings/AAP/q1.md", "filing", TODAY, False), ("Filings/AAPL/old.md", "filing", datetime.date(2020, 1, 1), False), (None, "filing", TODAY, False), ("Filings/AAPL/x.md", None, TODAY, False)]
    df = spark.createDataFrame(rows, "p string, k string, d date, want boolean").withColumn("a", a)
    assert df.first().a.words == ["margin", "trends", "in"]
    assert df.where(notes.anchored(F.col("a"), F.col("p"), F.col("k"), F.col("d")) != F.col("want")).count() == 0
    free = df.withColumn("a", notes.anchors(F.lit("margin"), (), F.lit(TODAY)))
    assert free.where(notes.anchored(F.col("a"), F.col("p"), F.col("k"), F.col("d"))).count() == len(rows)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mr. Smith bought. He sold!  Then what? 5 more.", ["Mr. Smith bought.", "He sold!", "Then what?", "5 more."]), ("The U.S. Market fell. It rose.", ["The U.S. Market fell.", "It rose."]),
        ("Costs rose, e.g. Rent. $5 each.", ["Costs rose, e.g. Rent.", "$5 each."]), ("Second sentence here. .", ["Second sentence here."]), ("no capital. after it", ["no capital. after it"]), ("  ", []), (None, []), ("A. B", ["A. B"][:0]),
    ],
)
def test_sentences(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(notes.sentences(F.col("t"))).first()[0] == want


def test_top_sentences_in_order(spark):
    rows = [("d", 0, "far", [0.0, 1.0]), ("d", 1, "near", [1.0, 0.1]), ("d", 2, "nearest", [1.0, 0.0]), ("e", 0, "one", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "k string, at int, s string, v array<double>").withColumn("q", F.array(F.lit(1.0), F.lit(0.0)))
    got = {r.k: r.sentences for r in notes.top_in_order(df, ["k"], "at", "s", "v", "q").collect()}
    assert got == {"d": ["near", "nearest"], "e": ["one"]}


def test_chunks_by_heading(spark):
    long = " ".join(f"w{i}" for i in range(23))
    df = spark.createDataFrame([(1, f"intro text\n# First  \nbody one\n\n## Empty\n### Long\n{long}\n"), (2, None), (3, ""), (4, "# only"), (5, "#\nbare")], "id int, t string")
    got = [tuple(r) for r in notes.heading_chunks(df, "id", "t", 10, 4).orderBy("id", "ord").collect()]
    w = long.split()
    assert got == [(1, 0, None, "intro text"), (1, 1, "First", "body one"), (1, 2, "Long", " ".join(w[:10])), (1, 3, "Long", " ".join(w[6:16])), (1, 4, "Long", " ".join(w[12:22])), (1, 5, "Long", " ".join(w[18:])), (5, 0, None, "bare")]


def test_mentions_equal_brute_force(spark):
    docs = [(1, "Rates stay HIGH for long"), (2, "an élan of rates"), (3, None), (4, ""), (5, "AI"), (6, "a\nb rates\nstay")]
    titles = [(1, "rates"), (2, "high for"), (3, "AI"), (4, "ÉLAN"), (5, None), (6, "rates\nstay"), (7, "RATES")]
    want = sorted((d, t) for d, x in docs for t, n in titles if x and n and len(n) >= 3 and n.lower() in x.lower())
    got = notes.mentions(spark.createDataFrame(docs, "d int, x string"), "d", "x", spark.createDataFrame(titles, "t int, n string"), "t", "n")
    assert sorted(map(tuple, got.collect())) == want
    several = notes.mentions(spark.createDataFrame(docs, "d int, x string"), "d", "x", spark.createDataFrame(titles, "t int, n string"), "t", "n", block_bytes=100)
    assert sorted(map(tuple, several.collect())) == want
    none = notes.mentions(spark.createDataFrame(docs, "d int, x string"), "d", "x", spark.createDataFrame([(1, "AI")], "t int, n string"), "t", "n")
    assert none.count() == 0 and none.columns == ["d", "t"]


@pytest.mark.parametrize("text,since", [("mare 2024", "2024-01-01"), ("octember 2024", "2024-01-01"), ("junuary 2023", None), ("Sept 2024", "2024-09-01"), ("in SEPTEMBER 2023", "2023-09-01"), ("may 2022", "2022-05-01"), ("dec  2021", "2021-12-01"), ("marched 1999", None), ("mar 1999", "1999-03-01")])
def test_months_by_their_names(spark, text, since):
    got = spark.createDataFrame([(text,)], "t string").select(notes.anchors(F.col("t"), (), F.lit(TODAY)).alias("a")).first().a.since
    year = since or (f"{text[-4:]}-01-01" if text[-4:].startswith("20") else None)
    assert str(got) == str(year)


def test_dots_behind_an_abbreviation(spark):
    rows = spark.createDataFrame([("He said No.. Then he left. Yes... Then we ate.",)], "t string")
    assert rows.select(notes.sentences(F.col("t")).alias("s")).first().s == ["He said No.. Then he left.", "Yes...", "Then we ate."]


def test_notes_and_feeds(spark, tmp_path):
    (tmp_path / "n" / "deep").mkdir(parents=True)
    (tmp_path / "n" / "a.md").write_text('---\nkind: book\ntitle: "A b"\nkind: note\n---\n\nBody: x\n')
    (tmp_path / "n" / "deep" / "plain.md").write_text("no front matter")
    (tmp_path / "n" / "skip.txt").write_text("x")
    got = {r.name: (r.front, r.title, r.body) for r in files.read_notes(spark, f"{tmp_path}/n").collect()}
    assert got == {"a.md": ({"title": "A b", "kind": "note"}, "A b", "Body: x"), "plain.md": ({}, "plain", "no front matter")}
    (tmp_path / "rss.xml").write_text("<rss><channel><title>c</title><item><title> One </title><link>http://a</link><pubDate>Mon</pubDate></item><item><title>Two</title></item></channel></rss>")
    assert [tuple(r) for r in files.read_feed(spark, f"{tmp_path}/rss.xml").collect()] == [("One", "http://a", "Mon", None), ("Two", None, None, None)]
    (tmp_path / "atom.xml").write_text('<feed><entry><title>E</title><link href="http://b"/><updated>2026</updated><summary>s</summary></entry></feed>')
    assert [tuple(r) for r in files.read_feed(spark, f"{tmp_path}/atom.xml", atom=True).collect()] == [("E", "http://b", "2026", "s")]


def test_sentences_of_the_table(spark):
    """Every sentence stands in its text, in order, once blanks are one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", notes.sentences(F.col("text")).alias("s")).collect()
    for r in docs:
        body, at = re.sub(r"\s+", " ", r.text or ""), 0
        for s in r.s:
            at = body.index(s, at) + len(s)
