"""Tables in the folder that driver and executors share, and the size of what goes to Python at once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a table in spark.checkpoint.dir (a local folder where that is unset): cuts lineage and outlives any executor."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/siltstone/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes that go to Python together. Spark counts rows alone, ten thousand of them, and a row may be a whole text or a block of vectors.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Has the session send rows to Python in batches of some BATCH_BYTES, or of one row where that is larger."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
