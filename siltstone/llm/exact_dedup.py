"""Exact duplicates by a tree merge of sorted digest runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import ascii_lower, join_hot, settled, written

#: Runs that one merge takes in, as bits.
FAN_BITS = 3
_KEY = ["digest", "n_bytes", "check"]


def digests(docs: DataFrame) -> DataFrame:
    """docs with the text's SHA-256 after lower-casing A-Z (null counts as empty), its byte length and a second hash.

    Rows merge only where all three agree, which is how equality is verified without moving texts.
    """
    text = ascii_lower(F.coalesce("text", F.lit("")))
    return docs.withColumn("_normal", text).select(
        *docs.columns,
        F.unhex(F.sha2("_normal", 256)).alias("digest"),
        F.octet_length("_normal").cast("long").alias("n_bytes"),
        F.xxhash64("_normal").alias("check"),
    )


def merge_runs(rows: DataFrame, keep: str) -> DataFrame:
    """One row for each digest: best (the struct of the row that stays) and n_rows.

    rows: digest, n_bytes, check, doc_id, row. Each input partition is a run. In every round, groups of
    2**FAN_BITS runs exchange slices of the digest range and merge them: a slice gets a third of a byte
    narrower as the runs get fewer, so that no task ever holds a whole run of the corpus. max and min of a
    struct make Spark aggregate by sorting: a map task sorts its run and folds equal digests before the
    exchange, and the task that receives the runs merges them in digest order, keeping the best row.
    """
    runs = 1 + (rows.select(F.spark_partition_id().alias("run")).agg(F.max("run")).first()[0] or 0)
    rounds = 1
    while 1 << (FAN_BITS * rounds) < runs:
        rounds += 1
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    if keep == "max":
        best = F.struct(F.col("doc_id").isNotNull().alias("none"), "doc_id", "row")
    fold = F.max if keep == "max" else F.min
    level = rows.select(F.spark_partition_id().alias("run"), *_KEY, best.alias("best"), F.lit(1).cast("long").alias("n_rows"))
    lead = F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int")  # the first 24 bits
    for k in range(1, rounds + 1):
        bits = min(24, FAN_BITS * k)
        run = F.shiftright("run", FAN_BITS) if k < rounds else F.lit(0)
        merged = level.withColumn("run", run).withColumn("slice", F.shiftright(lead, 24 - bits))
        level = merged.groupBy("slice", "run", *_KEY).agg(fold("best").alias("best"), F.sum("n_rows").alias("n_rows")).drop("slice")
    return level.drop("run")


def exact_dedup(docs: DataFrame, keep: str = "min") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs.

    Of rows with equal texts the one with the smallest doc_id stays (keep="max": the largest). A null doc_id
    stays only where no other row of its group has an id; of rows with the same id and text just one is kept.
    Null and empty texts are one group. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep is min or max, not {keep!r}")
    rows = written(digests(docs.select("doc_id", "text")).drop("text").withColumn("row", F.monotonically_increasing_id()), "digests")
    groups = written(merge_runs(rows, keep), "digest-groups")
    return join_hot(rows, groups, _KEY, "n_rows", rows.count()).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n_rows").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, keep: str = "min", row: str | None = None) -> DataFrame:
    """The rows of docs that stay (see exact_dedup()), all columns. Rows with the same id and text count as one.

    row: a column that names each row once and is the same in every reading; it isn't returned. Without it, the rows are written with a
    number. Only digests are grouped, and only row names say which rows go. Null and empty texts are one group; other columns may
    have any names; an empty table stays empty.
    """
    named = {c: f"column{i}" for i, c in enumerate(docs.columns) if c != row}
    of = {name: c for c, name in named.items()}
    if row is None:
        numbered = written(docs.withColumnsRenamed(named).withColumn("row", F.monotonically_increasing_id()), "numbered")
    else:
        numbered = docs.withColumnsRenamed({**named, row: "row"})
    own = numbered.select(F.col(named["doc_id"]).alias("doc_id"), F.col(named["text"]).alias("text"), "row")
    stay = settled(docs.sparkSession, "staying", lambda: merge_runs(written(digests(own).drop("text"), "digests"), keep).select(F.col("best.row").alias("row")))
    # nearly all rows stay, so their names are shuffled like the rows, at any size
    return numbered.join(stay.hint("shuffle_hash"), "row", "left_semi").drop("row").withColumnsRenamed(of)
