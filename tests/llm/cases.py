"""Rows that every operator must cope with: nulls, empty and long texts, ties, repeated rows and clashing names."""

from __future__ import annotations

#: (doc_id, text)
ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "plain words only"),
    (5, "plain words only"),
    (5, "plain words only"),
    (None, "a row without an id"),
    (None, None),
    (6, "Ünïcode ßtraße 东京 😀 é ½ Ⅷ"),
    (7, "word " * 60_000),
    (8, "PLAIN words ONLY"),
    (9, "1234 5678 !!"),
    (10, "line\r\nbreak\x0btab\x0cfeed\x00nul"),
]

SCHEMA = "doc_id long, text string"
#: Columns of names that the operators use themselves.
CLASHING = ("digest", "row", "run", "best", "sid", "root", "token", "items", "lang_pred", "score", "block", "key", "_keep", "n_rows", "kept")


def frame(spark, rows=ODD, partitions=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def clashing(spark, rows=ODD):
    from pyspark.sql import functions as F

    return frame(spark, rows).withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sample(spark, sf="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")


def rows_of(df, *columns):
    """Rows as sorted tuples; nulls first."""
    found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(found, key=lambda r: [(x is not None, x) for x in r])
