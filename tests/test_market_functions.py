"""Rules on symbols, days, labels, cycles, quotes and amounts, at their edges."""

import datetime

import pytest
from pyspark.sql import functions as F

from siltstone.functions import market, text
from siltstone.operators import citations, graph, timeseries
from siltstone.sources import files


@pytest.mark.parametrize(
    ("symbol", "want"),
    [("BTC-USD", "crypto"), ("eth-usdc ", "crypto"), ("SPY", "etf"), ("BTCUSDT", "crypto"), ("AAPL", "stock"), ("NETH", "stock"), ("XUSDT", "stock"), (None, "stock"), ("", "stock")],
)
def test_asset_class(spark, symbol, want):
    df = spark.createDataFrame([(symbol,)], "s string")
    assert df.select(market.asset_class(F.col("s"), ("SPY",))).first()[0] == want


def test_trading_days(spark):
    sat, mon = datetime.date(2026, 5, 9), datetime.date(2026, 5, 11)
    rows = [("crypto", sat, True), ("stock", sat, False), (" Stock ", sat, False), (None, sat, True), ("new", sat, True), ("etf", mon, True)]
    df = spark.createDataFrame(rows, "c string, d date, want boolean")
    assert df.where(market.is_trading_day(F.col("c"), F.col("d")) != F.col("want")).count() == 0


def test_label_filters(spark):
    df = spark.createDataFrame([(" sector:tech, insider_buy:true,bad,:x,y:,n:3,a:b:c",), (None,)], "s string")
    got = [[tuple(p) for p in r[0]] for r in df.select(market.label_filters(F.col("s"))).collect()]
    assert got == [[("sector", '"tech"'), ("insider_buy", "true"), ("n", "3"), ("a", '"b:c"')], []]


@pytest.mark.parametrize(
    ("series", "want"),
    [([0.5, -0.1], "late"), ([-0.5, 0.4], "recession"), ([-0.5, 1.5], "recession"), ([1.0, 1.5], "early"), ([0.5, 0.9], "mid"), ([0.9, 0.5], "mid"),
     ([0.8, -0.2, 0.7], "mid"), ([1.5, 1.55], "mid"), ([1.0, 1.125], "early")],
)
def test_cycle_phase(spark, series, want):
    df = spark.createDataFrame([("us", i, v) for i, v in enumerate(series)], "k string, t int, v double")
    assert timeseries.cycle_phase(df, ["k"], "t", "v").first()["phase"] == want


def test_change_by_a_negative_first_value(spark):
    df = spark.createDataFrame([("a", 1, -2.0), ("a", 2, -1.0), ("b", 1, 0.0), ("b", 2, 1.0)], "k string, t int, v double")
    got = {r.k: (r.pct, r.fired) for r in timeseries.change_pct(df, ["k"], "t", "v", 10).collect()}
    assert got == {"a": (-50.0, False), "b": (None, False)}


def test_quotes_with_ellipses(spark):
    body = "The quick brown fox jumps over the lazy dog and runs away"
    rows = [("quick brown ... lazy dog", "match"), ("... quick brown fox", "not_found"), ("quick brown fox", "match"), ("..............", "not_found"), ("lazy dog … quick brown", "not_found")]
    df = spark.createDataFrame(rows, "q string, want string").withColumn("t", F.lit(body))
    assert [(r.q, r.got) for r in df.select("q", citations.quote_status(F.col("q"), F.col("t")).alias("got")).collect()] == rows


def test_amounts(spark):
    rows = [("542 Million", 542.0), ("$14.79", 14.79), ("$427.4 m", 427.4), ("1.2 b", 1200.0), ("1,250", 1250.0), ("none", None), ("1.2.3", None), (None, None)]
    df = spark.createDataFrame(rows, "s string, want double")
    assert [(r.s, r.got) for r in df.select("s", text.money_value(F.col("s")).alias("got")).collect()] == rows


def test_tables_with_short_rows(spark, tmp_path):
    (tmp_path / "o.tsv").write_text("\t".join(["2026-05-08", " meta "] + ["x"] * 8) + "\n2026-05-08\tMU\tshort\n")
    assert [(r.ticker, r.ratio) for r in files.read_tsv(spark, str(tmp_path / "o.tsv"), files.OPTIONS).collect()] == [("META", "x")]
    (tmp_path / "h.tsv").write_text("Ticker\tETF?\nMU\tno\n")
    assert [tuple(r) for r in files.read_tsv_with_header(spark, str(tmp_path / "h.tsv")).collect()] == [("MU", "no")]


def test_pagerank_to_a_tolerance(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "a", 2.0)], "src string, dst string, weight double")
    got = {r.node: r["rank"] for r in graph.pagerank(edges, 100, tolerance=1e-4).collect()}
    rank = dict.fromkeys("abcd", 0.25)
    for _ in range(100):
        rank = {"a": 0.0375 + 0.85 * (rank["c"] + rank["d"]), "b": 0.0375 + 0.85 * rank["a"], "c": 0.0375 + 0.85 * rank["b"], "d": 0.0375}
    assert all(abs(got[k] - rank[k]) < 1e-3 for k in rank)
