"""Every query of the library's own operators against its SQL in DuckDB, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from siltstone.plans import desk, discovery, documents, lifecycle, market, research, streams  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else f"{float(v):.6g}" if float(v) % 1 else str(int(v))
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(market.ORACLE))
def test_equals_sql(spark, duck, name):
    got = market.QUERIES[name](spark, SF)
    want = duck.execute(market.ORACLE[name])
    want_names = [c[0] for c in want.description]
    a, b = rows_of(got.columns, got.collect()), rows_of(want_names, want.fetchall())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]
    assert a[1] or name in ("drop_audit",), "no rows"


def test_min_gap_against_a_fold(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").collect()
    last, kept = {}, {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        key = (r.user_id, r.event_type)
        if key in last and (r.ts - last[key][0]).total_seconds() < 3600:
            kept[last[key][1]] += 1
        else:
            last[key] = (r.ts, r.event_id)
            kept[r.event_id] = 0
    got = {r.kept_id: r.n_dropped for r in market.QUERIES["dedupe_window"](spark, SF).collect()}
    assert got == kept


def test_registered(spark):
    import __spark_entry__ as entry

    assert set(market.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert documents.bm25_topk.__name__ in entry.queries()
    assert entry.entry(spark).count() > 0


def test_stream_windows_equal_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from siltstone.streaming.events import windowed

    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    values = {"n": F.count(F.lit(1))}
    q = windowed(stream, "ts", ["event_type"], values, "1 day", late="60 days").writeStream.format("memory").queryName("win").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("win").collect()))
    finally:
        q.stop()
    assert got == sorted(map(tuple, windowed(batch, "ts", ["event_type"], values, "1 day").collect()))


def _by_hand(rows, gap):
    last, kept = {}, {}
    for k, t, i in sorted(rows):
        if k in last and t - last[k][0] < gap:
            kept[last[k][1]] += 1
        else:
            last[k], kept[i] = (t, i), 0
    return kept


def test_large_groups_are_spread(spark):
    """No task takes a whole hot group: the plans have no window over it and no array of it; results span ranges."""
    import random

    from pyspark.sql import functions as F

    from siltstone.operators import retrieval, timeseries, trading

    draw = random.Random(3)
    rows = [("hot", draw.randrange(40_000), i) for i in range(4000)] + [(f"k{i % 9}", draw.randrange(10**6), 4000 + i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
    for gap in (5, 300, 50_000):
        got = {r.kept_id: r.n_dropped for r in timeseries.keep_min_gap(df, ["k"], "ts", "id", gap).collect()}
        assert got == _by_hand(rows, gap), gap
    want = {i: n for k in {r[0] for r in rows} for n, (_, i) in enumerate(sorted((-s, i) for own, s, i in rows if own == k), 1)}
    deferred = trading.defer_beyond(df, ["k"], "s", "id", 5)
    decay = retrieval.ladder_decay(df, "k", [F.desc("s"), F.col("id")])
    assert {r.id: r.place for r in deferred.collect()} == want
    assert {r.id: r.place + 1 for r in decay.collect()} == want
    for out in (deferred, decay, timeseries.keep_min_gap(df, ["k"], "ts", "id", 5)):
        plan = out._jdf.queryExecution().toString()
        assert "Window" not in plan and "collect_list" not in plan


def test_queries_of_a_search_are_not_broadcast(spark):
    from siltstone.operators import retrieval

    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(600)] + [(600, None), (601, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = retrieval.knn(v, "vec_id", "embedding", v.toDF("query_id", "query"), 3)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    places = {(r.query_id, r.place): r.vec_id for r in got.collect()}
    assert len(places) == 3 * 602
    # 35 apart are equal vectors: the first ids win; null ones have no similarity, and ids decide
    assert all(places[i, p + 1] == i % 35 + 35 * p for i in range(600) for p in range(3) if i % 35)
    assert [places[600, p] for p in (1, 2, 3)] == [places[601, p] for p in (1, 2, 3)] == [0, 1, 2]


def test_blocks_of_a_search_are_read_where_they_lie():
    """A batch of many pairs of blocks takes no more Python memory than one of few."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from siltstone.operators import retrieval

    def pairs(n):
        v, q = np.ones((1024, 16)).tobytes(), np.ones((16, 16)).tobytes()
        ids, asked = pa.array([list(range(1024))] * n, pa.list_(pa.int64())), pa.array([list(range(16))] * n, pa.list_(pa.int64()))
        dims = pa.array([16] * n, pa.int32())
        return pa.RecordBatch.from_arrays([ids, dims, pa.array([v] * n), asked, dims, pa.array([q] * n)], ["ids", "dim", "data", "q_ids", "q_dim", "q_data"])

    peaks = []
    for n in (2, 40):
        batch = pairs(n)
        tracemalloc.start()
        found = sum(b.num_rows for b in retrieval._nearest(5, True)([batch]))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        # of six ids, all zero to five, each query that is one of them leaves out itself
        assert found == n * (16 * 6 - 6)
    assert peaks[1] < 1.5 * peaks[0], peaks
