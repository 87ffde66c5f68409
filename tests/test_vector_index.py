"""The vector index against a search through everything."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.operators import retrieval, vector_index

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").cache()


@pytest.fixture(scope="module")
def index(vectors):
    return vector_index.build(vectors, "vec_id", "embedding")


def queries_of(vectors):
    return vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def found(df, id_="id"):
    return {(r["query_id"], r["place"]): (r[id_], round(r["similarity"], 9)) for r in df.collect()}


def test_exact_form_and_recall(vectors, index):
    queries = queries_of(vectors)
    want = found(retrieval.knn(vectors, "vec_id", "embedding", queries, 10), "vec_id")
    assert found(vector_index.search(index, queries, 10, probes=2, exact=True)) == want
    probes = vector_index.tuned_probes(index, vectors.where("vec_id % 10 = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10)
    assert probes < len(index.centroids)
    near = {(q, i) for (q, _), (i, _) in found(vector_index.search(index, queries, 10, probes=probes)).items()}
    recall = sum((q, i) in near for (q, _), (i, _) in want.items()) / len(want)
    assert recall >= 0.9, recall
    some = vector_index.search(index, queries, 3, exact=True, exclude_self=True).collect()
    assert all(r.id != r.query_id for r in some) and len(some) == 3 * queries.count()


def test_every_row_is_indexed_and_lists_are_sliced(spark, vectors, index):
    rows = index.lists.select("list", F.explode("rows").alias("r")).select("list", "r.rep")
    assert rows.distinct().count() == rows.count() == index.copies.select("rep").distinct().count()
    assert index.copies.count() == vectors.count()
    hot = spark.range(9000).select(F.col("id"), F.array(F.lit(1.0), F.col("id").cast("double") / 1e6).alias("v"))
    sliced = vector_index.build(hot, "id", "v", lists=1)
    assert sliced.lists.count() == 5 and sliced.lists.agg(F.max(F.size("rows"))).first()[0] < 2400


def test_many_copies_are_one_entry(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(3000 + i, rng.normal(size=3).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(8)
    index = vector_index.build(df, "id", "v")
    assert index.lists.agg(F.sum(F.size("rows"))).first()[0] == 301
    queries = df.where("id in (5, 3001)").select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    assert found(vector_index.search(index, queries, 7, exact=True)) == found(retrieval.knn(df, "id", "v", queries, 7), "id")
    got = vector_index.search(index, queries.where("query_id = 5"), 4, exclude_self=True).orderBy("place").collect()
    assert [r.id for r in got] == [0, 1, 2, 3]


def test_from_a_floor(vectors, index):
    queries = queries_of(vectors)
    got = {(r.query_id, r.rep) for r in vector_index.from_floor(index, queries, 0.4).collect()}
    every = retrieval.knn(vectors, "vec_id", "embedding", queries, vectors.count()).where("similarity >= 0.4").collect()
    reps = {r.rep for r in index.copies.collect()}
    assert got == {(r.query_id, r.vec_id) for r in every if r.vec_id in reps} and len(got) > queries.count()


def test_no_cross_join(vectors, index):
    plan = vector_index.search(index, queries_of(vectors), 5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [0.0, -2.0]), (10, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("rep", F.lit(1)).withColumn("list", F.lit("x"))
    index = vector_index.build(df, "id", "v")
    queries = df.select(F.col("id").alias("query_id"), F.col("v").alias("query")).distinct()
    got = {(r.query_id, r.place): r.id for r in vector_index.search(index, queries, 5, exact=True).collect()}
    assert got == {(6, 1): 6, (6, 2): 7, (6, 3): 9, (7, 1): 6, (7, 2): 7, (7, 3): 9, (9, 1): 9, (9, 2): 6, (9, 3): 7}
    none = vector_index.build(df.where("id is null"), "id", "v")
    assert vector_index.search(none, queries, 5).count() == 0


def test_temporal_pairs_are_left_out(spark):
    from siltstone.functions import text

    rows = [("2024-01-01-apple", 0, 1, [1.0, 0.0]), ("2024-01-02-apple", 0, 2, [1.0, 0.01]), ("pear", 0, 3, [1.0, 0.2]), ("pear", 1, 4, [0.0, 1.0]), ("plum", 0, 5, [0.1, 1.0])]
    chunks = spark.createDataFrame(rows, "node string, ord int, id long, v array<double>")
    similar = vector_index.similar_nodes(chunks, "node", "ord", "id", "v", 6, exact=True)
    links = {(r.node, r.other, r.place) for r in vector_index.cross_links(similar, "node", text.temporal_pair).collect()}
    assert links == {("2024-01-01-apple", "pear", 1), ("2024-01-02-apple", "pear", 1), ("pear", "2024-01-02-apple", 1), ("pear", "2024-01-01-apple", 2), ("plum", "pear", 1)}


def _lists(x):
    return pa.array(x.tolist(), pa.list_(pa.float64()))


def test_a_task_gives_out_few_rows_at_once():
    """However many lists a query looks at, and however many queries a batch has."""
    rng = np.random.default_rng(1)
    c, q = rng.normal(size=(300, 8)), rng.normal(size=(2000, 8))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    shared = SimpleNamespace(value=(c, np.full(300, 3.0)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), _lists(q), pa.nulls(2000, pa.float64())], ["query_id", "q", "least"])
    sizes = [b.num_rows for b in vector_index._probes(shared, 0, -1.0)([batch])]
    assert sum(sizes) == 600_000 and max(sizes) < 20_000


def _block_pairs(n, rng):
    """n rows of a slice of 1024 vectors and a block of 32 queries, with a least similarity of 0.4 for every other query."""
    slices, blocks = [], []
    for _ in range(n):
        slices += [{"rep": j, "v": v} for j, v in enumerate(rng.normal(size=(1024, 16)).tolist())]
        blocks += [{"query_id": j, "q": v, "least": 0.4 if j % 2 else None} for j, v in enumerate(rng.normal(size=(32, 16)).tolist())]
    vector = pa.list_(pa.float64())
    rows = pa.array(slices, pa.struct([("rep", pa.int64()), ("v", vector)]))
    queries = pa.array(blocks, pa.struct([("query_id", pa.int64()), ("q", vector), ("least", pa.float64())]))
    cut = [pa.ListArray.from_arrays(pa.array(range(0, len(x) + 1, len(x) // n), pa.int32()), x) for x in (rows, queries)]
    return pa.RecordBatch.from_arrays(cut, ["rows", "queries"])


def test_blocks_are_read_where_they_lie():
    """A batch of many blocks takes no more Python memory than one of few."""
    rng, peaks = np.random.default_rng(2), []
    for n in (2, 40):
        batch = _block_pairs(n, rng)
        tracemalloc.start()
        for _ in vector_index._meet(5, None)([batch]):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0], peaks


def test_hits_below_the_least_that_counts_are_not_passed_on():
    found = [r for b in vector_index._meet(50, None)([_block_pairs(1, np.random.default_rng(3))]) for r in b.to_pylist()]
    assert sum(r["query_id"] % 2 == 0 for r in found) == 16 * 50
    odd = [r["similarity"] for r in found if r["query_id"] % 2]
    assert odd and min(odd) >= 0.4 and len(odd) < 16 * 50


def test_blocks_go_to_python_a_few_megabytes_at_once(spark, monkeypatch):
    """However many blocks of queries a list meets."""

    def sizes(k, floor):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([0], pa.int64()), pa.array([float(b.nbytes)])], ["query_id", "rep", "similarity"])

        return run

    rows = spark.range(9000).select("id", F.array(*[F.rand(i) for i in range(64)]).alias("v"))
    index = vector_index.build(rows, "id", "v", lists=1)
    asked = rows.where("id < 2000").select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.lit(None).cast("double").alias("least"), F.lit(0).alias("list"))
    monkeypatch.setattr(vector_index, "_meet", sizes)
    got = vector_index._hits(index, asked, 5, None).collect()
    assert sum(r.query_id for r in got) == 5 * 8 and max(r.similarity for r in got) < 8e6, got
