"""Ordered folds over hot keys, dealt by ranges."""

import datetime
import random

from pyspark.sql import functions as F

from siltstone.operators import timeseries

T0 = datetime.datetime(2024, 1, 1)


def test_a_hot_key_is_dealt_by_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(500), i, rng.choice([None, None, None, rng.randrange(9)])) for i in range(3000)]
    # a long stretch without a value reaches over several ranges
    rows += [("still", t, 10_000 + t, 7 if t == 3 else None) for t in range(2000)]
    df = spark.createDataFrame(rows, "k string, t int, i long, v int").repartition(5)
    got = {r.i: r.seen for r in timeseries.last_so_far(df, ["k"], ["t", "i"], F.col("v"), "seen").collect()}
    last = {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        last[k] = v if v is not None else last.get(k)
        assert got[i] == last[k]
    assert len(got) == len(rows)
    assert timeseries.last_so_far(df.limit(0), ["k"], ["t", "i"], F.col("v"), "seen").count() == 0


def test_as_of_join_with_a_hot_key(spark):
    rng = random.Random(2)
    left = [("hot" if i % 3 else "b", T0 + datetime.timedelta(seconds=rng.randrange(5000)), i) for i in range(600)]
    right = [("hot" if i % 4 else "b", T0 + datetime.timedelta(seconds=rng.randrange(5000)), float(i % 5)) for i in range(300)]
    schema = "k string, ts timestamp"
    joined = timeseries.asof_join(spark.createDataFrame(left, schema + ", i int"), spark.createDataFrame(right, schema + ", v double"), ["k"], "ts", "v", 30)
    got = {r.i: (r.right_ts, r.right_value) for r in joined.collect()}
    for k, t, i in left:
        near = max(((s, v) for q, s, v in right if q == k and s <= t), default=None)
        assert got.get(i) == (near if near and (t - near[0]).total_seconds() <= 30 else None)
    # every window is within a range
    for part in joined._jdf.queryExecution().executedPlan().toString().split("Window [")[1:]:
        assert "_p" in part.split("]")[1] or "_p#" in part


def test_as_of_join_at_the_edge_of_the_tolerance(spark):
    """Parts of a second count, null keys meet nothing."""
    day, micro = datetime.timedelta(days=1), datetime.timedelta(microseconds=1)
    left = [("a", T0 + day, 1), ("b", T0 + day + micro, 2), ("c", T0 + day + 700_000 * micro, 3), (None, T0, 4), ("d", None, 5), ("e", T0 + day, 6)]
    right = [("a", T0, 1.0), ("b", T0, 2.0), ("c", T0, 3.0), (None, T0, 4.0), ("d", T0, 5.0), ("e", None, 6.0)]
    for kind in ("timestamp", "timestamp_ntz"):
        schema = f"k string, ts {kind}"
        joined = timeseries.asof_join(spark.createDataFrame(left, schema + ", i int"), spark.createDataFrame(right, schema + ", v double"), ["k"], "ts", "v", 86_400)
        assert [r.i for r in joined.collect()] == [1]


def test_trailing_windows_over_blocks(spark):
    rng = random.Random(3)
    rows = [(t, rng.choice([rng.uniform(1, 9), rng.uniform(1, 9), 0.0]), rng.uniform(1, 9)) for t in range(700)]
    df = spark.createDataFrame(rows, "t long, x double, y double").repartition(5)
    a, b = df.select("t", F.col("x").alias("v")), df.select("t", F.col("y").alias("v"))
    for corr in (timeseries.rolling_correlation, timeseries.aligned_correlation):
        whole = {r.t: r["corr"] for r in corr(a, b, "t", "v", 20).collect()}
        cut = {r.t: r["corr"] for r in corr(a, b, "t", "v", 20, block=60).collect()}
        assert whole.keys() == cut.keys() and sum(c is not None for c in whole.values()) > 200
        assert all(c == cut[t] or abs(c - cut[t]) < 1e-9 for t, c in whole.items())
