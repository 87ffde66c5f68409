"""Helpers shared by the operators: the shared folder, written tables, hot-key joins and text basics."""

from __future__ import annotations

import contextlib
import ctypes
import string
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many keys can each hold more than 1/HEAVY of the rows, so a table of them has a proven size.
HEAVY = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where that is unset."""
    set_here = spark.conf.get("spark.checkpoint.dir", None)
    if set_here:
        return set_here.rstrip("/")
    jsc_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jsc_dir.isDefined():
        return jsc_dir.get().rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex[:12]}"


#: Tables that a call of settled() has written so far.
_OWN: ContextVar[list[str] | None] = ContextVar("own", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and outlives any executor. Inside settled() it goes when that ends."""
    path = scratch(df.sparkSession, name)
    if _OWN.get() is not None:
        _OWN.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, made: Callable[[], DataFrame]) -> DataFrame:
    """What made() returns as a table; the tables that it wrote on its way are removed, also where it fails."""
    mine: list[str] = []
    outer = _OWN.set(mine)
    try:
        df = made()
        path = scratch(spark, name)
        df.write.parquet(path)
    finally:
        _OWN.reset(outer)
        for old in mine:
            removed(spark, old)
    if _OWN.get() is not None:
        _OWN.get().append(path)
    schema = df.schema
    del df
    spark._jvm.System.gc()  # so that the driver's cleaner drops the shuffle files of queries that are over
    return spark.read.schema(schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(df: DataFrame) -> None:
    """Removes a table of written() that nothing reads any more, before the settled() around it ends."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        removed(df.sparkSession, folder)


def file_row() -> Column:
    """Names a row of a table that is read from Parquet files as it stands: a 128-bit digest of the file's path, and the place in the file.

    For tables right from spark.read, or with columns or rows left out; other tables don't have it, or have it several times.
    """
    path = F.col("_metadata.file_path")
    return F.struct(F.xxhash64(path).alias("a"), F.xxhash64(path, F.lit(1)).alias("b"), F.col("_metadata.row_index").alias("i"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that for a text of ASCII characters and is much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows inner-joined with groups (unique on keys, count = rows per key), however uneven the keys are.

    Keys that hold over 1/HEAVY of the total are at most HEAVY; they are broadcast.
    The others are even enough for a shuffled join.
    """
    hot = F.col(count) * HEAVY > total
    heavy = groups.where(hot)
    first = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(groups.where(~hot), keys)
    return first.unionByName(rest)


def local_path(uri: str) -> str:
    """The path of a file: URI, as Python's open() takes it."""
    return uri[len("file://") :] if uri.startswith("file://") else uri.removeprefix("file:")


#: Rows that go to and from Python together: with the usual ten thousand, texts of some kilobytes make batches of tens of
#: megabytes, which are held several times over on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Has the session send whole texts to Python in batches of BATCH_ROWS at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: What operators keep in a reused worker from task to task, by operator: how to drop it.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(operator: str, drop: Callable[[], None]) -> None:
    """Says that an operator keeps something in its workers, and how to drop it."""
    _KEPT[operator] = drop


def only(operator: str) -> None:
    """At the start of a task: drops what other operators kept in this worker."""
    for name, drop in _KEPT.items():
        if name != operator:
            drop()
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: workers are reused, and what one stage held would weigh on the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
