"""Scalar functions, file readers and communities on small cases."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import communities
from siltstone.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("got", "want"),
    [
        (lambda: text.slug(F.lit("  Über Café, 2nd ed.!")), "ber-caf-2nd-ed"),
        (lambda: text.slug(F.lit("abc def"), 4), "abc"),
        (lambda: text.without_front_matter(F.lit("---\na: 1\n---\nbody\n---\n")), "body\n---\n"),
        (lambda: text.undated(F.lit("2024-01-31-note")), "note"),
        (lambda: text.temporal_pair(F.lit("2024-01-31-note"), F.lit("2024-02-01-note")), True),
        (lambda: text.temporal_pair(F.lit("note"), F.lit("2024-02-01-note")), False),
        (lambda: text.money_millions(F.lit("raised $1.2 Billion")), 1200.0),
        (lambda: text.money_millions(F.lit("542 million, then 3 billion")), 542.0),
        (lambda: text.money_millions(F.lit("none")), None),
        (lambda: text.half_life(F.lit(7.0), 7), 0.5),
        (lambda: text.half_life(F.lit(-3.0), 7), 1.0),
        (lambda: text.backoff_seconds(F.lit(1)), 30.0),
        (lambda: text.backoff_seconds(F.lit(20)), 3600.0),
        (lambda: text.append_capped(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit("d")), ["b", "c", "d"]),
        (lambda: text.append_capped(F.array(F.lit("a")), F.lit("a")), ["a"]),
        (lambda: text.append_capped(F.lit(None).cast("array<string>"), F.lit("a")), ["a"]),
        (lambda: text.query_terms(F.lit("Margin of-Safety, a X")), ["margin", "of", "safety"]),
        (lambda: text.approx_tokens(F.lit("a b  c")), 3),
    ],
)
def test_scalars(spark, got, want):
    x = value(spark, got())
    assert x == pytest.approx(want) if isinstance(want, float) else x == want


def test_next_run(spark):
    friday = F.lit("2024-03-08 22:00:00").cast("timestamp")  # after 16:30 in New York
    got = value(spark, F.date_format(text.next_run(friday, "America/New_York", 16, 30), "yyyy-MM-dd HH:mm"))
    assert got == "2024-03-11 20:30"  # Monday, summer time


def test_readers(spark, tmp_path):
    (tmp_path / "insiders.tsv").write_text("2026-05-08\t META \tMeta\t1\tA \"B\"\tCEO\t10\t1\t2\t+\n2026-05-08\t\tNone\n")
    rows = files.read_tsv(spark, str(tmp_path / "insiders.tsv"), files.INSIDERS).collect()
    assert [(r.ticker, r.person, r.sign) for r in rows] == [("META", 'A "B"', "+")]
    (tmp_path / "funds.json").write_text(json.dumps({"f": ["AMZN\tAmazon\tnew", "MU"], "g": []}))
    assert sorted(map(tuple, files.read_holdings(spark, str(tmp_path / "funds.json")).collect())) == [("f", "AMZN", "Amazon", "new"), ("f", "MU", None, None)]
    day = {"1. open": "1", "2. high": "3", "3. low": "1", "4. close": "2", "5. volume": "10"}
    (tmp_path / "bars.json").write_text(json.dumps({"Meta Data": {"2. Symbol": "IBM"}, "Time Series (Daily)": {"2026-04-20": day, "2026-04-21": {"4. close": "?"}}}))
    got = files.read_daily_bars(spark, str(tmp_path / "bars.json")).collect()
    assert [(r.symbol, r.ts, r.close, r.amount) for r in got] == [("IBM", datetime.date(2026, 4, 20), 2.0, 20.0)]
    (tmp_path / "macro.csv").write_text("DATE,DGS10\n2026-04-01,4.25\n2026-04-02,.\n")
    assert [(r.symbol, float(r.value)) for r in files.read_macro_csv(spark, str(tmp_path / "macro.csv"), "DGS10").collect()] == [("DGS10", 4.25)]
    (tmp_path / "c.vtt").write_text("WEBVTT\n\n00:01.500 --> 00:03.000 align:start\nHello <b>big</b>\nworld\n\n01:00:02.000 --> 01:00:03.000\n<i></i>\n\n01:00:04.000 --> 01:00:05.000\nbye\n")
    assert [(r.start_s, r.text) for r in files.read_captions(spark, str(tmp_path / "c.vtt")).orderBy("start_s").collect()] == [(1.5, "Hello big world"), (3604.0, "bye")]


def test_communities(spark):
    cliques = [(f"{g}{i}", f"{g}{j}", 1) for g in "abc" for i in range(5) for j in range(i)]
    edges = spark.createDataFrame([*cliques, ("a0", "b0", 1), ("b1", "c0", 1)], "src string, dst string, weight long")
    got = communities.communities(edges, rounds=8)
    groups = {}
    for r in got.collect():
        groups.setdefault(r.community, set()).add(r.node)
    assert communities.modularity(edges, got) > 0.4
    assert sum(map(len, groups.values())) == 15 and all(min(g) == c for c, g in groups.items())
    assert communities.communities(edges.limit(0), rounds=2).count() == 0


def test_centrality(spark):
    import numpy as np

    pairs = [(0, 1, 2), (1, 2, 1), (2, 0, 1), (2, 3, 1), (3, 3, 5)]
    a = np.eye(4)
    for s, d, w in pairs[:4]:
        a[s, d] += w
        a[d, s] += w
    x = np.ones(4)
    for _ in range(5):
        x = a @ x
        x /= np.linalg.norm(x)
    got = communities.eigenvector_centrality(spark.createDataFrame(pairs, "src long, dst long, weight long"), 5)
    assert [r.centrality for r in got.orderBy("node").collect()] == pytest.approx(x.tolist())


def test_new_clusters(spark):
    schema = "node string, community string"
    now = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "2"), ("e", "2"), ("f", "2"), ("g", "3")], schema)
    before = spark.createDataFrame([("a", "x"), ("b", "x"), ("d", "y"), ("e", "y"), ("f", "y"), ("h", "y")], schema)
    scores = spark.createDataFrame([("a", 0.1, 0.5), ("b", 0.2, 0.1), ("c", 0.2, 0.3)], "node string, centrality double, pagerank double")
    assert [tuple(r) for r in communities.new_clusters(now, before, scores).collect()] == [("1", 3, "c")]
