import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import toxicity
from siltstone.llm.queries import op11_toxicity
from tests.llm.cases import ODD, clashing, empty, sample


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in op11_toxicity(spark, sf).collect()}
    assert len(got) == docs.count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    hit = {0: [0, 0], 1: [0, 0]}
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.held_out and d in labels:
            hit[labels[d]][r.predicted] += 1
    assert hit[1][1] > 0.7 * sum(hit[1]), hit
    assert hit[0][1] < 0.01 * sum(hit[0]), hit


def test_labels_held_out_are_not_read(spark):
    docs, labels = sample(spark, "0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(toxicity.training_rows(docs, x)) for x in (labels, other))
    assert len(a.keys) and (a.keys == b.keys).all() and (a.weights == b.weights).all() and a.bias == b.bias


def plain_grams(text):
    w = text.split()
    return {
        *((x,) for x in w),
        *((x, y) for x, y in zip(w, w[1:])),
        *((x, y, z) for x, y, z in zip(w, w[1:], w[2:])),
        *((x, None, y) for x, y in zip(w, w[2:])),
        *((x, None, None, y) for x, y in zip(w, w[3:])),
    }


def test_grams_of_long_texts_are_whole():
    rng = np.random.default_rng(2)
    text = " ".join(f"w{k}" for k in rng.integers(0, 30, 1000))
    memo = toxicity._Words()
    whole = np.unique(np.concatenate(list(toxicity.grams(text, memo))))
    assert len(whole) == len(plain_grams(text))
    chunk, toxicity._CHUNK = toxicity._CHUNK, 7
    try:
        assert (np.unique(np.concatenate(list(toxicity.grams(text, memo)))) == whole).all()
    finally:
        toxicity._CHUNK = chunk
    assert list(toxicity.grams(None, memo)) == [] and len(list(toxicity.grams("one", memo))) == 1


def test_steps_of_ftrl_by_hand():
    """Against the published update, one coordinate at a time."""
    rng = np.random.default_rng(4)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.1
    model, z, n = toxicity.Ftrl(20, alpha, beta, l1, l2), np.zeros(20), np.zeros(20)

    def weight(i):
        if i == 0:
            return -z[0] * alpha / (beta + math.sqrt(n[0]))
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(60):
        at, y = np.unique(rng.integers(1, 20, 5)), int(rng.integers(0, 2))
        own = [0, *at.tolist()]
        w = {i: weight(i) for i in own}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in own:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
        model.learn(at, y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n) and math.isclose(model.bias(), weight(0))
    assert any(weight(i) == 0 for i in range(1, 20)) or l1 < 1


def test_copies_and_ties(spark):
    docs = spark.createDataFrame([(3 * k, "bad words here" if k % 2 else "good words here") for k in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    labels = labels.union(labels.withColumn("toxic", F.lit(None).cast("int")))
    rows = toxicity.training_rows(docs, labels).collect()
    assert sorted((r.text, r.label, r.rows) for r in rows) == [("bad words here", 1, 1), ("good words here", 0, 1)]
    even = labels.union(labels.withColumn("toxic", 1 - F.col("toxic")))
    assert {r.label for r in toxicity.training_rows(docs, even).collect()} == {1}
    many = docs.withColumn("text", F.concat("text", F.lit(" "), F.col("doc_id").cast("string")))
    drawn = toxicity.training_rows(many, labels, per_label=10).collect()
    assert [sum(r.label == y for r in drawn) for y in (0, 1)] == [10, 10] and all(r.rows > 10 for r in drawn)


def test_odd_rows(spark):
    model = toxicity.Model(np.sort(np.array([toxicity._Words()["plain"]], np.uint64)), np.array([9.0]), -3.0)
    docs = clashing(spark)
    got = toxicity.predict(docs, model)
    assert "text" not in got.columns
    rows = got.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.predicted == int(r.doc_id in (4, 5, 8))
        assert math.isclose(r.score, 1 / (1 + math.exp(-6 if r.predicted else 3)))
    none = toxicity.fit(toxicity.training_rows(empty(spark), spark.createDataFrame([], "doc_id long, toxic int")))
    assert toxicity.predict(empty(spark), none).count() == 0
    assert {r.predicted for r in toxicity.predict(docs, none).collect()} == {0}
