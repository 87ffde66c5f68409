"""Vector search by an inverted file: each vector lies in the list of its nearest centroid, and a query looks at few lists.

Equal vectors are indexed once, so a vector with very many copies is one entry. Long lists are cut into slices of a bounded number
of vectors; a slice and a block of queries meet as one row, found by the list's number, so no pair of a query and a
list that it doesn't look at is ever made. Cosine similarity; zero, null and broken vectors are in no list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.shared import settled, small_batches

#: Vectors in a slice of a list, and queries in a block.
SLICE, BLOCK = 2048, 256
#: Similarities to centroids that a task holds at once, and rows that it gives out at once.
CELLS, ROWS = 1 << 19, 1 << 13


@dataclass
class VectorIndex:
    """lists: list, part, rep (the least id of equal vectors), v. copies: rep, id of every indexed row. sizes: list, n, parts, reach."""

    centroids: np.ndarray
    lists: DataFrame
    copies: DataFrame
    sizes: DataFrame


def _units(values: list) -> np.ndarray:
    x = np.array(values, np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column, all non-null and of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pieces(batches, centroids: int):
    """The batches in pieces of so few rows that their similarities to all centroids are CELLS at most."""
    rows = max(1, CELLS // max(centroids, 1))
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products added up coordinate by coordinate: the same bits for equal vectors, in whatever block they stand."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        out += x[:, None] * y[None, :]
    return out


def _clusters(lists: int, rounds: int):
    """Spherical k-means of all rows of the one task, from seeds that are spread over the rows."""

    def run(batches):
        rows = [_matrix(b["v"]) for b in batches if b.num_rows]
        if not rows:
            return
        x = _units(np.concatenate(rows))
        c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
        for _ in range(rounds):
            step = max(1, CELLS // len(c))
            own = np.concatenate([(x[i : i + step] @ c.T).argmax(1) for i in range(0, len(x), step)])
            order = np.argsort(own, kind="stable")
            heads = np.flatnonzero(np.concatenate(([True], np.diff(own[order]) > 0)))
            c = c.copy()
            c[own[order][heads]] = np.add.reduceat(x[order], heads, axis=0)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(c)), pa.int32()), pa.array(c.tolist(), pa.list_(pa.float64()))], ["list", "c"])

    return run


def _sound(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, v: vectors of non-null finite numbers that aren't all zero, of the length that most of them have."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine)


def build(vectors: DataFrame, vec_id: str, vector: str, lists: int | None = None, sample: int = 20_000, rounds: int = 8, most: int = 4096) -> VectorIndex:
    """An index of all vectors.

    The centroids are fitted on a sample of at most `sample` distinct vectors, drawn by a hash of their ids; every vector is then put in
    a list. lists: about the root of the number of distinct vectors unless given, at most `most`, so the centroids, which go to all
    workers, have a bounded size. Rows of other lengths than the most frequent one are left out; of an id with several vectors
    the least counts; an empty table gives an index without lists.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    sound = _sound(vectors, vec_id, vector)
    lengths = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = lengths[0]["d"] if lengths else 0
    rows = settled(sound.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    equal = settled(rows.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_rows")), "equal-vectors")
    distinct, total = equal.select("rep", "v"), rows.count()
    # vectors that a thousandth of the rows equal are a thousand at most
    many = equal.where(F.col("n_rows") * 1000 > total).select("v", "rep")
    few = rows.join(F.broadcast(many), "v", "left_anti").join(equal.where(F.col("n_rows") * 1000 <= total).select("v", "rep"), "v")
    copies = settled(rows.join(F.broadcast(many), "v").unionByName(few).select("rep", "id"), "vector-copies")
    n = distinct.count()
    k = max(1, min(most, lists or round(n**0.5)))
    drawn = distinct.where(F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(1 << 30)) < 1.2 * sample / max(n, 1) * (1 << 30)).orderBy(F.xxhash64("rep", F.lit(7)), "rep").limit(sample)
    found = drawn.repartition(1).sortWithinPartitions("rep").mapInArrow(_clusters(k, rounds), "list int, c array<double>").collect()
    centroids = np.array([r["c"] for r in sorted(found, key=lambda r: r["list"])]) if found else np.zeros((0, dim))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        c = shared.value
        for part in _pieces(batches, len(c)):
            near = _units(_matrix(part["v"])) @ c.T
            own = near.argmax(1)
            angle = np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))
            yield pa.RecordBatch.from_arrays([part["rep"], part["v"], pa.array(own, pa.int32()), pa.array(angle)], ["rep", "v", "list", "angle"])

    dealt = settled(distinct.mapInArrow(assign, "rep long, v array<double>, list int, angle double"), "vector-lists")
    sizes = dealt.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("reach"))
    sizes = settled(sizes.withColumn("parts", F.ceil(F.col("n") / SLICE).cast("int")), "vector-list-sizes")
    # there are at most `most` lists
    parted = dealt.join(F.broadcast(sizes.select("list", "parts")), "list").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    blocks = parted.groupBy("list", "part").agg(F.collect_list(F.struct("rep", "v")).alias("rows"))
    return VectorIndex(centroids, settled(blocks, "vector-slices"), copies, sizes)


def _probes(shared, probes: int, floor: float | None, second: bool = False):
    """query_id, q, least, list: a query's nearest lists, or (floor) all lists that can hold a vector of that similarity, all of them where its floor is lower than any.

    Of queries with a least similarity: the lists beyond the nearest ones that can hold one as similar as that.
    """

    def run(batches):
        c, reach = shared.value
        for part in _pieces(batches, len(c)):
            near = np.clip(_units(_matrix(part["q"])) @ c.T, -1, 1)
            low = part["least"].to_numpy(zero_copy_only=False).astype(np.float64)  # NaN where it is null
            if probes:
                rank = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1, kind="stable")
                chosen = rank < probes
            if not probes or second:
                up = np.cos(np.maximum(0, np.arccos(near) - reach[None, :] - 1e-7))
                chosen = ~chosen & (up >= np.where(np.isnan(low), -2.0, low)[:, None] - 1e-9) if probes else up >= floor - 1e-9
            at, own = np.nonzero(chosen)
            for i in range(0, len(at), ROWS):
                rows, of = pa.array(at[i : i + ROWS]), pa.array(own[i : i + ROWS].astype(np.int32))
                yield pa.RecordBatch.from_arrays([part["query_id"].take(rows), part["q"].take(rows), part["least"].take(rows), of], ["query_id", "q", "least", "list"])

    return run


def _meet(k: int | None, floor: float | None):
    def run(batches):
        for batch in batches:
            # a row at a time, read where it lies: as Python objects a batch would take many times its size
            for i in range(batch.num_rows):
                rows, queries = batch["rows"].slice(i, 1).flatten(), batch["queries"].slice(i, 1).flatten()
                reps, v = rows.field("rep").to_numpy(), _matrix(rows.field("v"))
                ids, q = queries.field("query_id").to_numpy(), _matrix(queries.field("q"))
                least = queries.field("least").to_numpy(zero_copy_only=False).astype(np.float64)
                order = np.argsort(reps, kind="stable")
                reps, v = reps[order], v[order]
                norms = np.sqrt(_dots_own(v))[:, None] * np.sqrt(_dots_own(q))[None, :]
                sim = _dots(v, q) / norms
                if k is not None:
                    best = np.argsort(-sim, axis=0, kind="stable")[:k]
                    near, at, value = reps[best].T.ravel(), np.repeat(np.arange(len(ids)), len(best)), np.take_along_axis(sim, best, 0).T.ravel()
                    # what is below the least similarity that counts isn't passed on
                    keep = ~(value < least[at]) if floor is None else value >= floor
                    near, at, value = near[keep], at[keep], value[keep]
                else:
                    at_v, at = np.nonzero(sim >= floor)
                    near, value = reps[at_v], sim[at_v, at]
                for j in range(0, len(at), ROWS * 8):
                    cut = slice(j, j + ROWS * 8)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at[cut]], pa.int64()), pa.array(near[cut], pa.int64()), pa.array(value[cut])], ["query_id", "rep", "similarity"])

    return run


def _dots_own(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for x in a.T:
        out += x * x
    return out


def _hits(index: VectorIndex, probed: DataFrame, k: int | None, floor: float | None) -> DataFrame:
    """query_id, rep, similarity: of each slice that a query looks at its k best, or all from floor on."""
    # a row is a slice and a block: a megabyte, of which a partition has as many as its lists meet blocks
    small_batches(probed.sparkSession)
    blocks = probed.withColumn("_b", F.xxhash64("query_id"))
    counts = blocks.groupBy("list").agg(F.count(F.lit(1)).alias("m"))
    known = index.sizes.select("list", "parts").join(counts, "list")  # at most as many rows as lists
    blocks = blocks.join(F.broadcast(known), "list").withColumn("block", F.pmod("_b", F.ceil(F.col("m") / BLOCK)).cast("int"))
    packed = blocks.groupBy("list", "block").agg(F.collect_list(F.struct("query_id", "q", "least")).alias("queries"), F.first("parts").alias("parts"))
    dealt = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "part", "queries")
    met = index.lists.join(dealt, ["list", "part"]).select("rows", "queries")
    return met.mapInArrow(_meet(k, floor), "query_id long, rep long, similarity double")


def _best(hits: DataFrame, by: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), by)
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, exclude_self: bool = False) -> DataFrame:
    """query_id, id, similarity, place: each query's k nearest rows in its `probes` nearest lists; equal similarities by id.

    exact: what was found there sets a bound, and those of the other lists whose reach lets them hold something as near are looked
    at too; then the answer is that of a search through everything. exclude_self leaves out the id that equals
    query_id. Queries (query_id, query) may be as many as the vectors; broken ones and those of another length get no rows.
    """
    spark, more = queries.sparkSession, k + exclude_self
    dim = index.centroids.shape[1]
    asked = _sound(queries, "query_id", "query").where(F.size("v") == dim).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    reach = {r["list"]: r["reach"] for r in index.sizes.select("list", "reach").collect()}
    shared = spark.sparkContext.broadcast((index.centroids, np.array([reach.get(i, 0.0) for i in range(len(index.centroids))])))
    kind = "query_id long, q array<double>, least double, list int"
    unbound = asked.withColumn("least", F.lit(None).cast("double"))
    if not len(index.centroids):
        return spark.createDataFrame([], "query_id long, id long, similarity double, place int")
    found = _best(_hits(index, unbound.mapInArrow(_probes(shared, probes, None), kind), more, None), "rep", more)
    if exact:
        found = settled(found, "first-hits")
        # an entry may stand for several rows, so fewer entries than k set no tighter bound, but never a wrong one
        bound = found.where(F.col("place") == more).select("query_id", F.col("similarity").alias("least"))
        again = asked.join(bound, "query_id", "left").mapInArrow(_probes(shared, probes, None, second=True), kind)
        found = _best(found.drop("place").unionByName(_hits(index, again, more, None)), "rep", more)
    return _expanded(index, found.drop("place"), k, exclude_self)


def _expanded(index: VectorIndex, found: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The rows that entries stand for: of each entry the first ids, as many as an answer can take."""
    more = k + exclude_self
    own = Window.partitionBy("rep").orderBy("id")
    first = index.copies.withColumn("n", F.row_number().over(own)).where(F.col("n") <= more).drop("n")
    rows = found.join(first, "rep").drop("rep")
    if exclude_self:
        rows = rows.where("id <> query_id")
    return _best(rows, "id", k).select("query_id", "id", "similarity", "place")


def tuned_probes(index: VectorIndex, queries: DataFrame, k: int, target: float = 0.95, sample: int = 200) -> int:
    """How many lists a query must look at so that `target` of the k nearest rows are found, measured on at most `sample` of the queries."""
    spark = queries.sparkSession
    some = settled(queries.where("query_id IS NOT NULL").orderBy(F.xxhash64("query_id", F.lit(11)), "query_id").limit(sample), "tuning-queries")
    hits = search(index, some, k, exact=True).join(index.copies, "id")
    where = hits.join(index.lists.select("list", F.explode("rows.rep").alias("rep")), "rep").join(some, "query_id").select("list", F.col("query").cast("array<double>").alias("q"))
    shared = spark.sparkContext.broadcast(index.centroids)

    def ranks(batches):
        for b in _pieces(batches, len(shared.value)):
            near = _units(_matrix(b["q"])) @ shared.value.T
            own = near[np.arange(len(near)), b["list"].to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array((near > own[:, None]).sum(1).astype(np.int64) + 1)], ["rank"])

    counts = where.mapInArrow(ranks, "rank long").groupBy("rank").count().collect()  # as many rows as lists at most
    left = target * sum(r["count"] for r in counts)
    for r in sorted(counts, key=lambda r: r["rank"]):
        left -= r["count"]
        if left <= 0:
            return r["rank"]
    return 1


def from_floor(index: VectorIndex, queries: DataFrame, floor: float) -> DataFrame:
    """query_id, rep, similarity: all entries of the given similarity or more, exactly: lists whose reach can't hold one are not looked at."""
    spark = queries.sparkSession
    dim = index.centroids.shape[1]
    asked = _sound(queries, "query_id", "query").where(F.size("v") == dim).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    reach = {r["list"]: r["reach"] for r in index.sizes.select("list", "reach").collect()}
    shared = spark.sparkContext.broadcast((index.centroids, np.array([reach.get(i, 0.0) for i in range(len(index.centroids))])))
    probed = asked.withColumn("least", F.lit(None).cast("double")).mapInArrow(_probes(shared, 0, floor), "query_id long, q array<double>, least double, list int")
    return _hits(index, probed, None, floor)


def filtered(hits: DataFrame, facts: DataFrame, key: str, allowed: Column, k: int) -> DataFrame:
    """The first k of each query's hits whose facts (by key = id) are allowed; for this, hits are fetched beyond k (see overfetch())."""
    kept = hits.join(facts.withColumnRenamed(key, "id"), "id").where(allowed)
    w = Window.partitionBy("query_id").orderBy("place")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def overfetch(k: int, anchored: bool) -> int:
    """How many hits to fetch for k answers: 4k, 24 at least, four times as many where anchors will drop some (fixed by the search that this follows)."""
    return max(4 * k, 24) * (4 if anchored else 1)


def similar_nodes(chunks: DataFrame, node: str, ord_: str, vec_id: str, vector: str, k: int, asked: Callable[[DataFrame], DataFrame] = lambda n: n, **how) -> DataFrame:
    """node, other, similarity, place: for each node the k other nodes with the nearest chunk, searched by the node's first chunk.

    max(8k, 40) chunks are fetched; of a node's chunks the best counts, the node itself doesn't. asked picks the nodes
    to search for (all unless given) from (node, vec_id). Nodes of which that leaves fewer than k others get fewer.
    """
    first = Window.partitionBy(node).orderBy(ord_, vec_id)
    heads = chunks.select(node, ord_, vec_id, vector).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    index = build(chunks, vec_id, vector)
    heads = heads.join(asked(heads.select(node, vec_id)).select(node), node, "left_semi")
    hits = search(index, heads.select(F.col(vec_id).alias("query_id"), F.col(vector).alias("query")), max(8 * k, 40), **how)
    of = chunks.select(F.col(vec_id).alias("id"), F.col(node).alias("other"))
    by = hits.join(of, "id").join(heads.select(F.col(vec_id).alias("query_id"), node), "query_id").where(F.col("other") != F.col(node))
    best = by.groupBy(node, "other").agg(F.max("similarity").alias("similarity"), F.min("place").alias("_at"))
    w = Window.partitionBy(node).orderBy("_at")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("_at")


def cross_links(similar: DataFrame, node: str, temporal: Callable[[Column, Column], Column], floor: float = 0.78, k: int = 3) -> DataFrame:
    """Of similar_nodes() with 2k places: the first k that are similar enough and no other day's note of the same series."""
    kept = similar.where((F.col("similarity") >= floor) & ~temporal(F.col(node), F.col("other")))
    w = Window.partitionBy(node).orderBy("place")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
