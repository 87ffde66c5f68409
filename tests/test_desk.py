"""Rules and roll-ups of the desk at their edges: nulls, empty tables, ties, hot keys."""

import datetime

import pytest
from pyspark.sql import functions as F

from siltstone.functions import rules
from siltstone.operators import desk


@pytest.mark.parametrize(
    ("spec", "want"),
    [("c", ("close",)), (" OHLC ", ("open", "high", "low", "close")), ("all", rules.FIELDS), ("close,bogus, volume", ("close", "volume")), ("bogus", rules.BAR), (None, rules.BAR), ("a", ("amount",)), ("x", rules.BAR)],
)
def test_bar_fields(spec, want):
    assert rules.bar_fields(spec) == want


def test_weekdays(spark):
    df = spark.createDataFrame([(datetime.date(2026, 5, 9 + i),) for i in range(7)], "d date")  # Saturday first
    assert [r[0] for r in df.select(rules.on_weekdays(F.col("d"), "0, 5,9,x")).collect()] == [True, False, True, False, False, False, False]
    assert df.where(rules.on_weekdays(F.col("d"), "9")).count() == df.where(rules.on_weekdays(F.col("d"), None)).count() == 7


def test_due(spark):
    now = F.lit("2026-05-10 00:00:00").cast("timestamp")
    rows = [(True, "daily", "2026-05-09T00:00:00Z", True), (True, "daily", "2026-05-09T00:00:01Z", False), (True, "weekly", "2026-05-04", False), (True, "WEEKLY", "2026-05-03", True), (True, "manual", None, False),
            (True, None, None, False), (None, "daily", None, False), (False, "daily", None, False), (True, "daily", None, True), (True, "daily", "soon", True)]
    df = spark.createDataFrame(rows, "e boolean, c string, l string, want boolean")
    assert df.where(rules.is_due(F.col("e"), F.col("c"), F.col("l"), now) != F.col("want")).count() == 0
    assert df.where(rules.is_due(F.col("e"), F.col("c"), F.col("l"), now).isNull()).count() == 0


def test_severity_and_credibility(spark):
    df = spark.createDataFrame([(1, 0, 0, "high"), (0, 2, 0, "high"), (0, 1, 5, "medium"), (0, 0, 1, "low"), (None, None, None, "none")], "p int, c int, s int, want string")
    assert df.where(rules.severity(F.col("p"), F.col("c"), F.col("s")) != F.col("want")).count() == 0
    rows = [(1, 3, "strong", "thin"), (3, 3, "strong", "strong"), (3, 2, "strong", "moderate"), (2, 3, "unheard", "moderate"), (3, 3, "thin", "thin"), (0, 0, "strong", "none"), (3, 3, None, "none")]
    df = spark.createDataFrame(rows, "n int, t int, said string, want string")
    assert df.where(rules.credibility(F.col("n"), F.col("t"), F.col("said")) != F.col("want")).count() == 0


def test_other_rules(spark):
    df = spark.createDataFrame([("Please SELL now", 110.0, 100.0), ("sellers disclosed", 100.5, 100.0), (None, 1.0, 0.0), ("go short", 98.0, 100.0)], "t string, f double, a double")
    got = df.select(rules.speaks_of_exit(F.col("t")), rules.delta_band(F.col("f"), F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(True, "up"), (False, "flat"), (False, None), (True, "down")]
    one = df.limit(1).select(rules.token_cost(F.lit(1000), F.lit(None).cast("int"), 3.0, 15.0), rules.place_in(F.lit("HOLD"), ("BUY", "HOLD", "SELL")), rules.place_in(F.lit("?"), ("BUY",)))
    assert tuple(one.first()) == (0.003, 1, 1)
    a, b = df.select(rules.content_key(["a", "f"]).alias("x"), rules.content_key(["f", "a"]).alias("y")).first()
    assert a == b and len(a) == 64


def test_band_join_equals_brute_force(spark):
    import random

    draw = random.Random(5)
    keys = ["hot"] * 6 + ["a", "b", None]
    left = [(i, draw.choice(keys), draw.choice([draw.randrange(2000), None])) for i in range(200)]
    right = [(i, draw.choice(keys), draw.choice([draw.randrange(2000), None])) for i in range(200)] + [(900, "hot", 1000), (901, "hot", 1000)]
    l_df, r_df = (spark.createDataFrame(rows, f"{n} int, k string, {t} long").withColumn(t, F.timestamp_seconds(t)) for rows, n, t in ((left, "l", "at"), (right, "r", "ts")))
    for span in (1, 60, 5000):
        want = sorted((a[0], b[0]) for a in left for b in right if a[1] is not None and a[1] == b[1] and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= span)
        assert sorted((x.l, x.r) for x in desk.band_join(l_df, r_df, ["k"], "at", "ts", span).collect()) == want
    assert desk.band_join(l_df.limit(0), r_df, ["k"], "at", "ts", 60).count() == 0


def test_links_by_alias_path_and_last_part(spark):
    nodes = spark.createDataFrame([("b/Note.md",), ("a/note.md",), ("a/deep/x.md",), ("pic.png",)], "path string")
    aliases = spark.createDataFrame([("the x", "a/deep/x")], "alias string, canonical string")
    rows = [("b/Note.md", "b/Note.md"), ("b/Note", "b/Note.md"), ("NOTE", "a/note.md"), ("else/note.md", "a/note.md"), ("the x", "a/deep/x.md"), ("pic.png", "pic.png"), ("gone", None), ("pic", None)]
    edges = spark.createDataFrame([("s", d) for d, _ in rows], "src string, dst string")
    assert {r.dst: r.path for r in desk.resolve_links(edges, nodes, aliases).collect()} == dict(rows)


def test_week_change_of_short_series_and_bad_bases(spark):
    rows = [("six", i, float(i + 10)) for i in range(6)] + [("five", i, 1.0) for i in range(5)] + [("zero", i, float(i)) for i in range(6)]
    got = {r.k: (r.last_value, r.pct) for r in desk.week_change(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], "t", "v").collect()}
    assert got == {"six": (15.0, 50.0), "five": (1.0, None), "zero": (5.0, None)}
    assert desk.week_change(spark.createDataFrame([], "k string, t int, v double"), ["k"], "t", "v").count() == 0


def test_order_of_urgency(spark):
    now = datetime.datetime(2026, 5, 1)
    rows = [("never", None), ("b", now + datetime.timedelta(days=3)), ("a", now + datetime.timedelta(days=3)), ("late", now + datetime.timedelta(days=30)), ("past", now - datetime.timedelta(hours=1))]
    df = spark.createDataFrame(rows, "slug string, e timestamp_ntz")
    got = desk.most_urgent(desk.with_risk(df, "e", F.lit("2026-05-01").cast("timestamp")), "slug", 9).orderBy("place").collect()
    assert [(r.slug, r.days_left, r.at_risk) for r in got] == [("past", -1, True), ("a", 3, True), ("b", 3, True), ("late", 30, False), ("never", None, False)]


def test_nested_keys_whatever_the_order_of_names(spark):
    one = spark.sql("SELECT map('b', 1, 'a', 2) AS m, named_struct('y', array(named_struct('q', 1, 'p', 2)), 'x', 'v') AS s, 7 AS n")
    two = spark.sql("SELECT 7 AS n, named_struct('x', 'v', 'y', array(named_struct('p', 2, 'q', 1))) AS s, map('a', 2, 'b', 1) AS m")
    other = spark.sql("SELECT 7 AS n, named_struct('x', 'v', 'y', array(named_struct('p', 1, 'q', 2))) AS s, map('a', 2, 'b', 1) AS m")
    none = spark.sql("SELECT 7 AS n, CAST(NULL AS struct<x: string>) AS s, CAST(NULL AS map<string, int>) AS m")
    keys = [df.select(rules.nested_key(df, ["m", "s", "n"])).first()[0] for df in (one, two, other, none)]
    assert keys[0] == keys[1] and len(set(keys)) == 3
