"""Shards by size-tiered compaction: small immutable arrivals, merged by size, under a versioned manifest.

A root folder holds shards/<id>/ (Parquet files that never change) and manifest/v<number>.json (the shards that
are live in that version, one JSON object in a line each). DataFrame functions only; the driver handles the
manifest, whose size goes with the number of shards and not with the rows.
"""

from __future__ import annotations

import json
import math
import os
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed the same version."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def latest(spark: SparkSession, root: str) -> tuple[int, list[dict]]:
    """Number of the newest version, and its shards; (0, []) for a new root."""
    fs, folder = _fs(spark, f"{root}/manifest")
    if not fs.exists(folder):
        return 0, []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    version = max((int(x[1:-5]) for x in names if x.startswith("v") and x.endswith(".json")), default=0)
    if not version:
        return 0, []
    return version, [json.loads(r.value) for r in spark.read.text(f"{root}/manifest/v{version:08d}.json").toLocalIterator()]


def commit(spark: SparkSession, root: str, base: int, shards: list[dict]) -> int:
    """Makes shards the version after base; Conflict if another writer has. A reader sees the old or the new manifest, never part of one.

    The manifest is written under a trial name, then gets its final one in a step that fails where that name is taken: a
    hard link on a local file system, a rename without overwriting on HDFS. Object stores have no such step and are refused.
    """
    version = base + 1
    fs, final = _fs(spark, f"{root}/manifest/v{version:08d}.json")
    _, trial = _fs(spark, f"{root}/manifest/_trial-{uuid.uuid4().hex}")
    scheme = fs.getUri().getScheme()
    if scheme not in ("file", "hdfs", "viewfs"):
        raise ValueError(f"no atomic commit on {scheme}")
    out = fs.create(trial, False)
    out.write("".join(json.dumps(s) + "\n" for s in shards).encode())
    out.close()
    try:
        if scheme == "file":
            os.link(trial.toUri().getPath(), final.toUri().getPath())
        else:
            jvm = spark._jvm.org.apache.hadoop.fs
            none = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
            jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(trial, final, none)
    except FileExistsError:
        raise Conflict(f"version {version} exists") from None
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {version} exists") from None
        raise
    finally:
        fs.delete(trial, False)
    return version


def update(spark: SparkSession, root: str, change: Callable[[list[dict]], list[dict] | None], tries: int = 20) -> int:
    """Commits change(live shards); after a conflict again, on top of the other writer's version. None: nothing to commit."""
    for k in range(tries):
        base, live = latest(spark, root)
        shards = change(live)
        if shards is None:
            return base
        try:
            return commit(spark, root, base, shards)
        except Conflict:
            time.sleep(random.random() * 0.05 * (k + 1))
    raise Conflict(f"{tries} commits in a row met another writer's")


def _files(spark: SparkSession, folder: str, level: int) -> list[dict]:
    """A manifest entry for each file that a job wrote."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    found = [(str(s.getPath().toString()), s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]
    return [{"path": path, "bytes": size, "level": level} for path, size in sorted(found)]


def tier(n_bytes: int, target: int, growth: int = 4) -> int:
    """0 for shards of target size or more; each further tier is up to `growth` times smaller."""
    return 0 if n_bytes >= target // 2 else max(1, math.ceil(math.log(target / max(1, n_bytes), growth)))


def append(docs: DataFrame, root: str, arrival: str | None = None) -> int:
    """Adds docs as new small shards, a file from each input partition; each value of the column arrival is a commit of its own."""
    spark = docs.sparkSession
    folder = f"{root}/shards/{uuid.uuid4().hex[:12]}"
    if arrival is None:
        docs.write.parquet(folder)
        lots = [folder]
    else:
        docs.write.partitionBy(arrival).parquet(folder)
        fs, p = _fs(spark, folder)
        lots = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory())
    version = latest(spark, root)[0]
    for lot in lots:
        new = _files(spark, lot, 0)
        version = update(spark, root, lambda live, new=new: live + new)
    return version


def compact(spark: SparkSession, root: str, schema: str, target: int = 128 << 20, min_runs: int = 4) -> int:
    """Merges shards of similar size into files of about the target size, tier by tier until none has min_runs, each in a commit of its own.

    Files are put together without a shuffle. Shards of older versions stay on disk for their readers; expire()
    removes them. A merge whose shards another writer has replaced meanwhile is given up.
    """
    while True:
        version, live = latest(spark, root)
        tiers: dict[int, list[dict]] = {}
        for s in live:
            tiers.setdefault(tier(s["bytes"], target), []).append(s)
        tiers.pop(0, None)
        # the smallest shards first
        runs = next((r for _, r in sorted(tiers.items(), reverse=True) if len(r) >= min_runs), None)
        if runs is None:
            return version
        n = max(1, round(sum(r["bytes"] for r in runs) / target))
        folder = f"{root}/shards/{uuid.uuid4().hex[:12]}"
        spark.read.schema(schema).parquet(*[r["path"] for r in runs]).coalesce(n).write.parquet(folder)
        new, gone = _files(spark, folder, 1 + max(r["level"] for r in runs)), {r["path"] for r in runs}

        def replaced(now: list[dict], new=new, gone=gone) -> list[dict] | None:
            return [s for s in now if s["path"] not in gone] + new if gone <= {s["path"] for s in now} else None

        update(spark, root, replaced)


def expire(spark: SparkSession, root: str, age_s: float = 86_400) -> int:
    """Deletes shard files that the newest version doesn't hold and that are older than age_s seconds; gives their number.

    Younger ones may be what a writer has yet to commit, or what a reader of an older version is at.
    """
    before = (time.time() - age_s) * 1000
    fs, p = _fs(spark, f"{root}/shards")
    gone, found = 0, fs.listFiles(p, True)
    old = []
    while found.hasNext():
        f = found.next()
        if f.getPath().getName().startswith("part-") and f.getModificationTime() <= before:
            old.append(f.getPath())
    _, live = latest(spark, root)  # after listing, so that what was committed meanwhile is kept
    keep = {s["path"] for s in live}
    for path in old:
        if path.toString() not in keep:
            fs.delete(path, False)
            gone += 1
    return gone


def read_shards(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of the newest version with shard (file name) and manifest_version."""
    version, live = latest(spark, root)
    paths = [s["path"] for s in live]
    reader = spark.read.schema(schema)
    rows = reader.parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.withColumns({"shard": F.element_at(F.split(F.input_file_name(), "/"), -1) if paths else F.lit(""), "manifest_version": F.lit(version)})


def shard_documents(docs: DataFrame, root: str, arrivals: int = 4, target: int = 128 << 20) -> DataFrame:
    """doc_id, n_bytes, text_sha256, shard, manifest_version of each row, read back from the compacted shards.

    docs arrive in `arrivals` lots (a commit each), dealt by a hash of doc_id and text (so a hot id or source is spread, and
    repeated rows all stay), then are compacted. Null ids and texts stay null (n_bytes and digest too); an
    empty table gives no rows. Clashing column names don't matter: only doc_id and text are stored.
    """
    spark, schema = docs.sparkSession, "doc_id long, text string"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    append(rows.withColumn("arrival", F.pmod(F.xxhash64("doc_id", "text"), F.lit(arrivals))), root, "arrival")
    compact(spark, root, schema, target)
    return read_shards(spark, root, schema).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), "shard", "manifest_version"
    )
