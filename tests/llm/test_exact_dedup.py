import hashlib
from collections import defaultdict

import pytest

from siltstone.llm.exact_dedup import exact_dedup, keep_distinct
from tests.llm.cases import ODD, clashing, empty, frame, rows_of, sample

_LOW = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def expected(rows, keep):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(_LOW)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "max" else min)(known) if known else None
        out += [(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


@pytest.mark.parametrize("keep", ["min", "max"])
def test_against_brute_force(spark, keep):
    docs = sample(spark).select("doc_id", "text").repartition(40)
    rows = [tuple(r) for r in docs.collect()]
    got = exact_dedup(docs, keep)
    assert rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == expected(rows, keep)
    kept = [tuple(r) for r in got.where("kept").select("doc_id", "keep_id").collect()]
    assert all(a == b for a, b in kept)
    assert len(kept) == got.select("text_sha256").distinct().count()


def test_odd_rows(spark):
    for docs in (frame(spark), clashing(spark)):
        got = exact_dedup(docs, "max")
        assert rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == expected(ODD, "max")
        # of repeated rows just one stays
        assert got.where("kept").count() == len({(t or "").translate(_LOW) for _, t in ODD})
    assert exact_dedup(empty(spark)).count() == 0


def test_keep_distinct(spark):
    docs = clashing(spark)
    got = keep_distinct(docs, "max")
    assert got.columns == docs.columns
    best = {}
    for i, t in ODD:
        t = (t or "").translate(_LOW)
        best[t] = max([x for x in (best.get(t), i) if x is not None], default=None)
    assert rows_of(got, "doc_id") == sorted([(v,) for v in best.values()], key=lambda r: (r[0] is not None, r[0]))
    assert keep_distinct(empty(spark)).count() == 0


def test_native_plan(spark):
    got = exact_dedup(sample(spark), "max")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_keep_is_checked(spark):
    with pytest.raises(ValueError):
        exact_dedup(empty(spark), "last")


def test_rows_named_by_their_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from siltstone.llm.common import file_row
    from siltstone.llm.exact_dedup import keep_distinct
    from tests.llm.cases import clashing, rows_of

    clashing(spark).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    named = docs.withColumn("_row", file_row())
    assert named.select("_row").distinct().count() == docs.count()
    got = keep_distinct(named, keep="max", row="_row")
    assert got.columns == docs.columns
    assert rows_of(got, "doc_id", "text") == rows_of(keep_distinct(docs, keep="max"), "doc_id", "text")
    assert keep_distinct(named.where(F.lit(False)), row="_row").count() == 0
