"""Token counts by a digest cache: only texts that no earlier run has counted are encoded."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import join_hot, written
from siltstone.llm.encoding import encoder

_CACHE = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of how it is used."""
    h = hashlib.sha256(b"tokenizers, no special tokens added, special strings as by default\n")
    with open(path, "rb") as f:
        h.update(f.read())
    return h.hexdigest()[:24]


def _counter(path: str):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                n = enc.count(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["digest"], pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return run


def _cached(spark, folder: str) -> DataFrame | None:
    """The cache so far, or None; a text that two runs counted at once is there twice."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(_CACHE).parquet(folder)


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit): a row for each row of docs.

    A text's key is the SHA-256 of its UTF-8 bytes, null counting as the empty text (0 bytes, 0 tokens);
    byte-level tokenizers tell any two texts apart, so no further normalising is sound. The cache is a folder
    with a table for each tokenizer version, which new counts are appended to. Repeated rows are all returned;
    a null doc_id stays null; columns other than doc_id and text are ignored, whatever their names; an empty
    table gives an empty result. Long texts are counted whole.
    """
    spark = docs.sparkSession
    folder = f"{cache}/tokenizer={tokenizer_version(tokenizer_path)}"
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    rows = written(keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "count-rows")
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"))
    known, missing = _cached(spark, folder), keyed.select("digest", "text")
    if known is not None:
        # digests alone meet the cache; only texts that it lacks are moved
        lacking = written(sizes.select("digest").join(known.select("digest"), "digest", "left_anti"), "count-misses")
        missing = missing.join(lacking, "digest", "left_semi")
    missing.dropDuplicates(["digest"]).mapInArrow(_counter(tokenizer_path), _CACHE).write.mode("append").parquet(folder)
    counts = written(sizes.join(_cached(spark, folder), "digest").dropDuplicates(["digest"]), "count-groups")
    return join_hot(rows, counts, ["digest"], "n_rows", rows.count()).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
