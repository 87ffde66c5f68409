"""A stream's sink that takes each batch once, and the outbox that hands its rows on with retries.

All tables lie under one folder. Files are only ever added; which of them count says the newest manifest, and a manifest
is committed by a name that exists once. So a batch that runs again, a run that stops half-way and two runs at a
time leave nothing behind that a reader could see twice.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import backoff_seconds

#: Tables of the outbox.
ROWS = "id string, kind string, payload string, created_at timestamp"
ATTEMPTS = "id string, tried_at timestamp, ok boolean, error string"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def newest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the newest manifest: tables (name to folders) and last (the last batch of each stream)."""
    log = f"{root}/_manifests"
    if not _fs(spark, log).exists(_path(spark, log)):
        return 0, {"tables": {}, "last": {}}
    names = [f.getPath().getName() for f in _fs(spark, log).listStatus(_path(spark, log))]
    version = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
    if not version:
        return 0, {"tables": {}, "last": {}}
    data = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(_fs(spark, log).open(_path(spark, f"{log}/{version:012d}.json")), "UTF-8")
    return version, json.loads(data)


def _put(spark: SparkSession, root: str, version: int, manifest: dict) -> bool:
    """Whether this run is the one that committed the version."""
    log = f"{root}/_manifests"
    fs, target = _fs(spark, log), f"{log}/{version:012d}.json"
    draft = f"{log}/.{uuid.uuid4().hex}"
    out = fs.create(_path(spark, draft), False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            local = [p.removeprefix("file://").removeprefix("file:") for p in (draft, target)]
            os.link(*local)
            return True
        if fs.getUri().getScheme() not in ("hdfs", "viewfs"):
            raise ValueError("the outbox needs a file system whose renames never overwrite")
        return bool(fs.rename(_path(spark, draft), _path(spark, target)))
    except FileExistsError:
        return False
    finally:
        fs.delete(_path(spark, draft), False)


def commit(spark: SparkSession, root: str, change: Callable[[dict], dict | None], tries: int = 20) -> bool:
    """Puts change(manifest) in the manifest's place; anew if another run came first. False if change() gives None: nothing is to be done."""
    for _ in range(tries):
        version, manifest = newest(spark, root)
        new = change(manifest)
        if new is None:
            return False
        if _put(spark, root, version + 1, new):
            return True
    raise RuntimeError(f"no commit to {root} in {tries} tries")


def read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The rows of a table that count; none if it hasn't any yet."""
    folders = newest(spark, root)[1]["tables"].get(name, [])
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def sink(root: str, fan_out: dict[str, Callable[[DataFrame], DataFrame]], stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes each table of fan_out from the batch, and commits them together with the batch's number.

    A batch whose number has been committed is left alone, so replays change nothing; one that stopped before its commit
    is written anew, under another name.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number <= newest(spark, root)[1]["last"].get(stream, -1):
            return
        held = batch.persist()  # read once however many tables there are
        try:
            added = {name: f"{root}/{name}/{stream}-{number}-{uuid.uuid4().hex[:8]}" for name in fan_out}
            for name, made in fan_out.items():
                made(held).write.parquet(added[name])
        finally:
            held.unpersist()

        def change(manifest: dict) -> dict | None:
            if number <= manifest["last"].get(stream, -1):
                return None
            tables = dict(manifest["tables"])
            for name, folder in added.items():
                tables[name] = [*tables.get(name, []), folder]
            return {**manifest, "tables": tables, "last": {**manifest["last"], stream: number}}

        commit(spark, root, change)

    return run


def state(rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """id, kind, payload, created_at, attempts, completed_at, last_error, next_retry_at of each row of the outbox.

    A row is due at once; after a failure it waits (see backoff_seconds()) from that attempt on. Of rows with one id the first
    counts; after a success no more attempts count. Attempts for ids that aren't there are left out.
    """
    first = F.min(F.struct("created_at", "kind", "payload")).alias("r")
    one = rows.where("id IS NOT NULL").groupBy("id").agg(first)
    done = F.min(F.when(F.col("ok"), F.col("tried_at")))
    tried = attempts.groupBy("id").agg(done.alias("completed_at"), F.count(F.lit(1)).alias("attempts"), F.max("tried_at").alias("last_at"), F.max_by(F.when(~F.col("ok"), F.col("error")), F.struct("tried_at", "error")).alias("error"))
    both = one.join(tried, "id", "left")
    waits = F.timestamp_micros((F.unix_micros("last_at") + backoff_seconds(F.col("attempts")) * 1_000_000).cast("long"))
    return both.select(
        "id",
        *[F.col(f"r.{c}").alias(c) for c in ("kind", "payload", "created_at")],
        F.coalesce("attempts", F.lit(0)).cast("int").alias("attempts"),
        "completed_at",
        F.when(F.col("completed_at").isNull(), F.col("error")).alias("last_error"),
        F.when(F.col("completed_at").isNull(), F.coalesce(waits, F.col("r.created_at"))).alias("next_retry_at"),
    )


def due(states: DataFrame, now: Column, most: int = 100) -> DataFrame:
    """The rows to hand on at `now`: not completed and past their wait; the oldest first, at most `most`."""
    return states.where(F.col("completed_at").isNull() & (F.col("next_retry_at") <= now)).orderBy("created_at", "id").limit(most)


def after_attempts(states: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """states once results (id, ok, error) of attempts at `now` are known: one attempt more, and completed or put off. Others stay as they are."""
    tried = F.col("ok").isNotNull()
    n = F.col("attempts") + tried.cast("int")
    late = F.timestamp_micros((F.unix_micros(now) + backoff_seconds(n) * 1_000_000).cast("long"))
    out = states.join(results.where("ok IS NOT NULL").dropDuplicates(["id"]).select("id", "ok", "error"), "id", "left")
    return out.select(
        *[c for c in states.columns if c not in ("attempts", "completed_at", "last_error", "next_retry_at")],
        n.alias("attempts"),
        F.when(F.col("ok"), now).otherwise(F.col("completed_at")).alias("completed_at"),
        F.when(F.col("ok"), F.lit(None)).when(tried, F.col("error")).otherwise(F.col("last_error")).alias("last_error"),
        F.when(F.col("ok"), F.lit(None)).when(tried, late).otherwise(F.col("next_retry_at")).alias("next_retry_at"),
    )


def drain(spark: SparkSession, root: str, now: Column, deliver: Callable[[DataFrame], DataFrame], most: int = 100) -> dict[str, int]:
    """Hands on the due rows: deliver(rows) gives id, ok and error of each. Counts of scanned, ok and failed.

    The attempts are committed after delivery: a run that stops between the two delivers its rows again, which the receiver tells by
    their id. A row without a result counts as a failure.
    """
    rows = due(state(read(spark, root, "outbox", ROWS), read(spark, root, "attempts", ATTEMPTS)), now, most).persist()
    try:
        scanned = rows.count()
        if not scanned:
            return {"scanned": 0, "ok": 0, "failed": 0}
        results = deliver(rows).dropDuplicates(["id"]).select("id", "ok", "error")
        log = rows.select("id").join(results, "id", "left")
        log = log.select("id", now.alias("tried_at"), F.coalesce("ok", F.lit(False)).alias("ok"), F.when(F.col("ok"), F.lit(None)).otherwise(F.coalesce("error", F.lit("no result"))).alias("error"))
        folder = f"{root}/attempts/{uuid.uuid4().hex[:12]}"
        log.coalesce(1).write.parquet(folder)
    finally:
        rows.unpersist()
    commit(spark, root, lambda m: {**m, "tables": {**m["tables"], "attempts": [*m["tables"].get("attempts", []), folder]}})
    ok = spark.read.schema(ATTEMPTS).parquet(folder).where("ok").count()
    return {"scanned": scanned, "ok": ok, "failed": scanned - ok}


def purge(spark: SparkSession, root: str, now: Column, days: int) -> None:
    """Writes the outbox anew without rows that were completed more than `days` ago, and the attempts without theirs. Pending rows stay; days of 0 or less keep all."""
    if days <= 0:
        return
    seen = newest(spark, root)[1]["tables"]
    rows, attempts = read(spark, root, "outbox", ROWS), read(spark, root, "attempts", ATTEMPTS)
    gone = state(rows, attempts).where(F.unix_micros("completed_at") < F.unix_micros(now) - days * 86_400_000_000).select("id")
    folders = {name: f"{root}/{name}/purged-{uuid.uuid4().hex[:12]}" for name in ("outbox", "attempts")}
    rows.join(gone, "id", "left_anti").write.parquet(folders["outbox"])
    attempts.join(gone, "id", "left_anti").write.parquet(folders["attempts"])

    def change(manifest: dict) -> dict | None:
        tables = dict(manifest["tables"])
        for name, folder in folders.items():
            old = set(seen.get(name, []))
            if not old <= set(tables.get(name, [])):
                return None  # another purge came first
            tables[name] = [folder, *[f for f in tables.get(name, []) if f not in old]]
        return {**manifest, "tables": tables}

    commit(spark, root, change)
