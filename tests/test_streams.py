"""Streams against the batch form of the same function: shuffled and late events, and a restart from the checkpoint."""

import datetime
import random
import shutil

import pytest
from pyspark.sql import functions as F

from siltstone.streaming import outbox, state

T0 = datetime.datetime(2024, 3, 1)
LATE_S = 600


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def as_stream(spark, tmp_path, rows, schema, made, files=6, stop_after=3):
    """What made(stream) gives over rows that come in files, each up to LATE_S out of order, with a restart after some files; the last row is far ahead."""
    rng = random.Random(7)
    rows = sorted(rows, key=lambda r: r[-1] + datetime.timedelta(seconds=rng.uniform(0, LATE_S * 0.9)))
    size = -(-len(rows) // files)
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def put(k):
        part = rows[k * size : (k + 1) * size]
        df = spark.createDataFrame(part, schema).coalesce(1)
        df.write.parquet(str(tmp_path / f"w{k}"))
        for f in (tmp_path / f"w{k}").glob("*.parquet"):
            shutil.move(f, source / f"{k:03d}.parquet")

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = made(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()

    try:
        for k in range(stop_after):
            put(k)
        go()
        for k in range(stop_after, files):
            put(k)
        go()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    return spark.read.parquet(str(out))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_counted_duplicates_as_a_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, at(rng.randrange(0, 4000))) for i in range(400)]
    schema = "k string, id long, ts timestamp"
    want = rows_of(state.counted_duplicates(spark.createDataFrame(rows, schema), ["k"], "ts", "id", 60), "k", "kept_ts", "kept_id", "n_dropped")
    ended = [*rows, ("end", 10**6, at(10**6))]
    got = as_stream(spark, tmp_path, ended, schema, lambda s: state.counted_duplicates(s, ["k"], "ts", "id", 60, late=f"{LATE_S} seconds"))
    assert rows_of(got, "k", "kept_ts", "kept_id", "n_dropped") == want and len(want) > 60


def test_window_is_inclusive_and_anchored_at_the_first_kept(spark):
    rows = [("a", 1, at(0)), ("a", 2, at(50)), ("a", 3, at(60)), ("a", 4, at(61)), ("a", 5, at(110)), ("a", 6, None), ("b", 7, at(0)), ("b", 8, at(0))]
    got = state.counted_duplicates(spark.createDataFrame(rows, "k string, id long, ts timestamp"), ["k"], "ts", "id", 60)
    assert rows_of(got, "k", "kept_id", "n_dropped") == [("a", 1, 2), ("a", 4, 1), ("b", 7, 1)]


def test_late_actuals_as_a_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        t = rng.randrange(0, 3000)
        rows += [(k, "need", None, at(t)), (k, "need", None, at(t + 20))]
        if k % 3:
            rows += [(k, "bar", float(k), at(t + rng.choice([-30, 1, 90, 700, 3000]) + rng.random()))]
        if k % 5 == 1:
            rows += [(k, "bar", -1.0, at(9000))]
    rows += [(900, "bar", 1.0, at(5)), (901, "other", 1.0, at(5))]
    schema = "k long, kind string, v double, ts timestamp"
    columns = ("k", "outcome", "needed_at", "found_at", "value", "attempts")
    ended = [*rows, (-1, "bar", 0.0, at(10**6))]
    want = rows_of(state.late_actuals(spark.createDataFrame(ended, schema), ["k"], "ts", "kind", "v", 60, 24), *columns)
    got = as_stream(spark, tmp_path, ended, schema, lambda s: state.late_actuals(s, ["k"], "ts", "kind", "v", 60, 24, late=f"{LATE_S} seconds"))
    assert rows_of(got, *columns) == want
    outcomes = {r[0]: set() for r in want}
    for r in want:
        outcomes[r[0]].add(r[1])
    assert {frozenset(v) for v in outcomes.values()} == {frozenset({"found"}), frozenset({"gave_up"}), frozenset({"found", "gave_up"})}


def test_debounce_as_a_stream(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), i, at(rng.randrange(0, 6000))) for i in range(150)]
    schema = "k string, id long, ts timestamp"
    columns = ("k", "first_ts", "fire_ts", "n_requests")
    want = rows_of(state.debounced(spark.createDataFrame(rows, schema), "ts", ["k"], 30), *columns)
    ended = [*rows, ("end", 0, at(10**6))]
    got = as_stream(spark, tmp_path, ended, schema, lambda s: state.debounced(s, "ts", ["k"], 30, late=f"{LATE_S} seconds"))
    assert rows_of(got, *columns) == want


ALERTS = "id string, source string, kind string, payload string, ts timestamp"


def alerts(spark, rows):
    return spark.createDataFrame([(i, s, k, "{}", at(t)) for i, s, k, t in rows], ALERTS)


#: Alerts of the chart's source are kept as context and handed on, all of them are kept.
FAN_OUT = {
    "alerts": lambda df: df,
    "context": lambda df: df.where("source = 'tradingview'").select("id", "kind", "ts"),
    "outbox": lambda df: df.where("source = 'tradingview'").select("id", "kind", "payload", F.col("ts").alias("created_at")),
}


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/box"
    take = outbox.sink(root, FAN_OUT)
    one, two = alerts(spark, [("1", "tradingview", "note", 1), ("2", "other", "note", 2)]), alerts(spark, [("3", "tradingview", "idea", 3)])
    for batch, number in ((one, 0), (one, 0), (two, 1), (one, 0), (two, 1)):
        take(batch, number)
    assert rows_of(outbox.read(spark, root, "alerts", ALERTS), "id") == [("1",), ("2",), ("3",)]
    assert rows_of(outbox.read(spark, root, "context", "id string, kind string, ts timestamp"), "id") == [("1",), ("3",)]
    assert outbox.newest(spark, root)[0] == 2


def test_a_batch_that_fails_before_its_commit(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/box"
    one = alerts(spark, [("1", "tradingview", "note", 1), ("2", "other", "note", 2)])
    real = outbox.commit

    def broken(*args):
        raise OSError("lost")

    monkeypatch.setattr(outbox, "commit", broken)
    with pytest.raises(OSError):
        outbox.sink(root, FAN_OUT)(one, 0)
    assert outbox.read(spark, root, "alerts", ALERTS).count() == 0  # written, but not committed
    monkeypatch.setattr(outbox, "commit", real)
    outbox.sink(root, FAN_OUT)(one, 0)
    assert rows_of(outbox.read(spark, root, "alerts", ALERTS), "id") == [("1",), ("2",)]


def test_a_stream_into_the_outbox(spark, tmp_path):
    root, source = f"file://{tmp_path}/box", tmp_path / "in"
    alerts(spark, [(str(i), "tradingview" if i % 2 else "other", "note", i) for i in range(40)]).repartition(4).write.parquet(str(source))

    def go(folder):
        stream = spark.readStream.schema(ALERTS).option("maxFilesPerTrigger", 1).parquet(str(source))
        stream.writeStream.foreachBatch(outbox.sink(root, FAN_OUT)).option("checkpointLocation", str(tmp_path / folder)).trigger(availableNow=True).start().awaitTermination()

    go("check")
    go("check2")  # a checkpoint that was lost: all batches come again
    assert rows_of(outbox.read(spark, root, "outbox", outbox.ROWS), "id") == sorted((str(i),) for i in range(1, 40, 2))


def test_two_commits_at_a_time(spark, tmp_path):
    root = f"file://{tmp_path}/box"
    calls = []

    def change(manifest):
        calls.append(1)
        if len(calls) == 1:  # another one comes first
            outbox.commit(spark, root, lambda m: {**m, "last": {**m["last"], "b": 1}})
        return {**manifest, "last": {**manifest["last"], "a": 1}}

    assert outbox.commit(spark, root, change)
    assert outbox.newest(spark, root) == (2, {"tables": {}, "last": {"a": 1, "b": 1}}) and len(calls) == 2


def test_draining_with_retries(spark, tmp_path):
    root = f"file://{tmp_path}/box"
    outbox.sink(root, FAN_OUT)(alerts(spark, [(str(i), "tradingview", "note" if i else "odd", i) for i in range(5)]), 0)
    delivered = []

    def deliver(rows):
        delivered.append([r.id for r in rows.collect()])
        ok = F.col("kind") == "note"
        return rows.where("id <> '4'").select("id", ok.alias("ok"), F.when(~ok, "unknown kind").alias("error"))

    def now(seconds):
        return F.lit(at(seconds)).cast("timestamp")

    assert outbox.drain(spark, root, now(100), deliver, most=3) == {"scanned": 3, "ok": 2, "failed": 1}
    assert outbox.drain(spark, root, now(101), deliver) == {"scanned": 2, "ok": 1, "failed": 1}  # 0 waits, 4 has no result
    assert outbox.drain(spark, root, now(102), deliver) == {"scanned": 0, "ok": 0, "failed": 0}
    assert outbox.drain(spark, root, now(130), deliver) == {"scanned": 1, "ok": 0, "failed": 1}
    assert outbox.drain(spark, root, now(189), deliver)["scanned"] == 1  # only 4: a second failure waits a minute
    assert delivered == [["0", "1", "2"], ["3", "4"], ["0"], ["4"]]
    found = {r.id: r for r in outbox.state(outbox.read(spark, root, "outbox", outbox.ROWS), outbox.read(spark, root, "attempts", outbox.ATTEMPTS)).collect()}
    assert (found["0"].attempts, found["0"].last_error, found["0"].next_retry_at) == (2, "unknown kind", at(190))
    assert (found["4"].attempts, found["4"].last_error) == (2, "no result") and found["1"].completed_at == at(100)
    outbox.purge(spark, root, now(86_400 + 101), 1)  # what was completed at 100 goes, at 101 stays
    left = rows_of(outbox.read(spark, root, "outbox", outbox.ROWS), "id")
    assert left == [("0",), ("3",), ("4",)]
    again = {r.id: r.attempts for r in outbox.state(outbox.read(spark, root, "outbox", outbox.ROWS), outbox.read(spark, root, "attempts", outbox.ATTEMPTS)).collect()}
    assert again == {"0": 2, "3": 1, "4": 2}


def test_stopped_between_delivery_and_commit(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/box"
    outbox.sink(root, FAN_OUT)(alerts(spark, [("1", "tradingview", "note", 1)]), 0)
    now, seen = F.lit(at(10)).cast("timestamp"), []

    def deliver(rows):
        seen.extend(r.id for r in rows.collect())
        return rows.select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))

    with monkeypatch.context() as m:
        m.setattr(outbox, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            outbox.drain(spark, root, now, deliver)
    assert outbox.drain(spark, root, now, deliver) == {"scanned": 1, "ok": 1, "failed": 0}
    assert seen == ["1", "1"] and outbox.drain(spark, root, now, deliver)["scanned"] == 0
