"""A corpus pipeline of the llm operators: from raw documents to packed sequences.

Each stage takes the documents that the one before it kept and returns those that it keeps, with the columns of
documents; the last one returns the packed pieces. Between stages the documents are a Parquet table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontam, exact_dedup, langid, ngram_join, packing
from siltstone.llm.common import file_row, settled, written
from siltstone.llm.queries import WORD_BPE

#: SQL can't express the classifier, nor the packing.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, null ones too, and those that are far from every language's centroids. Repeated rows fare alike; an empty table stays empty."""
    model = langid.fit(langid.training_rows(docs))
    return langid.predict(docs, model).where(~F.col("rejected")).select(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with _row, a name of each row: its place in its file, as stages read what the one before wrote; other tables are written once with numbers."""
    try:
        return docs.withColumn("_row", file_row())
    except AnalysisException:
        return written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text, the one with the largest doc_id: null and empty texts are one text, an id counts before none, of equal rows one stays."""
    return exact_dedup.keep_distinct(_numbered(docs), keep="max", row="_row").select(*docs.columns)


def distinct_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies (five words, similarity 0.8).

    An id with several rows stays if any of them does; rows without an id stay.
    """
    groups = ngram_join.similarity_groups(docs, size=5, num=4, den=5)
    gone = groups.groupBy("doc_id").agg(F.bool_and(F.col("component_id") != F.col("doc_id")).alias("gone")).where("gone").select("doc_id")
    gone = written(gone, "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark passages make up a twentieth of, or more. Each row is judged by its own text, whatever its id."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _numbered(docs)
    own = rows.select(F.col("_row").alias("doc_id"), "text")
    gone = settled(spark, "gone", lambda: decontam.decontaminate(own, benchmark).where("contaminated").select(F.col("doc_id").alias("_row")))
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences of 4096 tokens. A null text is its end id alone; repeated rows are packed each."""
    return packing.pack(docs, WORD_BPE, end_id=1, size=4096)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", distinct_groups),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = written(out, f"stage-{k + 1}") if k + 1 < len(STAGES) else out
    return docs
