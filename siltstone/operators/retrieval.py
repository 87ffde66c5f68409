"""Retrieval: lexical and vector search, fusion, decay, audit, chunks and recurring lines."""

from __future__ import annotations

import string
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.timeseries import numbered
from siltstone.shared import settled, small_batches

#: BM25's constants and the ladder of weights for the items of one group (fixed values).
K1, B = 1.2, 0.75
LADDER = (1.0, 0.6, 0.45, 0.35, 0.25)


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, two characters or more."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def bm25(docs: DataFrame, doc_id: str, text: str, terms: Sequence[str]) -> DataFrame:
    """doc_id, score of each document with one of the terms; terms that most documents hold count next to nothing.

    Texts are split once, and none of their tokens is shuffled: the few counts of each document are written, and read for the
    corpus statistics (a single row, which is broadcast) and for the scores.
    """
    # the generator keeps the split from being worked out anew for each term
    own = docs.select(doc_id, F.explode(F.array(tokens(F.col(text)))).alias("_t"))
    tf = [(F.size("_t") - F.size(F.array_remove("_t", t))).alias(f"_tf{i}") for i, t in enumerate(terms)]
    rows = settled(own.select(doc_id, F.size("_t").alias("_len"), *tf), "term-counts")
    stats = rows.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.ln((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(f"_tf{i}") * (K1 + 1) / (F.col(f"_tf{i}") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    some = rows.where(" or ".join(f"_tf{i} > 0" for i in range(len(terms))))
    return some.join(F.broadcast(stats)).select(doc_id, score.alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _blocks(rows: int):
    """Up to `rows` vectors of one length in a row: ids, and their coordinates as bytes; dim is -1 for vectors that are null or hold a null."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, rows):
                groups: dict[int, tuple[list, list]] = {}
                for id_, v in zip(b["id"].slice(i, rows).to_pylist(), b["v"].slice(i, rows).to_pylist(), strict=True):
                    dim = -1 if v is None or None in v else len(v)
                    ids, values = groups.setdefault(dim, ([], []))
                    ids.append(id_)
                    values.append([] if dim < 0 else v)
                data = [np.array(values, "<f8").tobytes() for _, values in groups.values()]
                yield pa.RecordBatch.from_arrays([pa.array([ids for ids, _ in groups.values()], pa.list_(pa.int64())), pa.array(list(groups), pa.int32()), pa.array(data, pa.binary())], ["ids", "dim", "data"])

    return run


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows of a with those of b, coordinate by coordinate: the same for equal vectors, wherever they stand."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        out += x[:, None] * y[None, :]
    return out


def _nearest(k: int, exclude_self: bool):
    def run(batches):
        for batch in batches:
            # a row at a time, its coordinates read where they lie
            for i in range(batch.num_rows):
                ids, queries = (batch[c].slice(i, 1).flatten().to_numpy() for c in ("ids", "q_ids"))
                dim, q_dim = batch["dim"][i].as_py(), batch["q_dim"][i].as_py()
                order = np.argsort(ids, kind="stable")
                ids, sim = ids[order], np.full((len(ids), len(queries)), -np.inf)
                if dim == q_dim and dim >= 0:
                    v, q = (np.frombuffer(batch[c][i].as_buffer(), "<f8").reshape(n, dim) for c, n in (("data", len(ids)), ("q_data", len(queries))))
                    v = v[order]
                    with np.errstate(all="ignore"):
                        norms = np.sqrt((_norms(v))[:, None]) * np.sqrt(_norms(q)[None, :])
                        sim = np.where(norms == 0, -np.inf, _dots(v, q) / norms)
                # nulls last, as -inf; NaN first, as Spark sorts it
                best = np.argsort(np.where(np.isnan(sim), -np.inf, -sim), axis=0, kind="stable")[: k + exclude_self]
                near, at = ids[best].T.ravel(), np.repeat(np.arange(len(queries)), len(best))
                value = np.take_along_axis(sim, best, 0).T.ravel()
                if exclude_self:
                    other = near != queries[at]
                    near, at, value = near[other], at[other], value[other]
                yield pa.RecordBatch.from_arrays([pa.array(queries[at]), pa.array(near), pa.array(value, mask=np.isneginf(value))], ["query_id", "vec_id", "similarity"])

    return run


def _norms(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for x in a.T:
        out += x * x
    return out


def knn(vectors: DataFrame, vec_id: str, vector: str, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """query_id, vec_id, similarity, place: each query's k nearest vectors by cosine, all vectors being compared.

    queries (query_id, query) may be as many as the vectors: both go in blocks of bounded size, each pair of blocks
    meets in some task, and only a block's own top k for each query is exchanged. Ids are non-null whole numbers, and an id is one vector.
    """
    small_batches(vectors.sparkSession)
    kind = "ids array<long>, dim int, data binary"
    mine = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_blocks(2048), kind)
    asked = queries.select(F.col("query_id").cast("long").alias("id"), F.col("query").cast("array<double>").alias("v")).mapInArrow(_blocks(256), kind)
    # each row is a pair of blocks; the hint keeps the queries from being broadcast whole
    met = mine.hint("shuffle_replicate_nl").crossJoin(asked.toDF("q_ids", "q_dim", "q_data"))
    ids = (vectors.schema[vec_id].dataType, queries.schema["query_id"].dataType)
    near = met.mapInArrow(_nearest(k, exclude_self), "query_id long, vec_id long, similarity double")
    scored = near.select(F.col("query_id").cast(ids[1]).alias("query_id"), F.col("vec_id").cast(ids[0]).alias(vec_id), "similarity")
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), vec_id)
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def centroids(vectors: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """keys, centroid: the mean vector of each group, added up place by place."""
    places = vectors.select(*keys, F.posexplode(vector).alias("_at", "_x")).groupBy(*keys, "_at").agg(F.avg("_x").alias("_x"))
    return places.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda p: p["_x"]).alias("centroid"))


def rank_fusion(legs: Sequence[tuple[DataFrame, float]], key: str, place: str, c: int = 60) -> DataFrame:
    """key, score: weight / (c + place from 0), added up over the legs that hold the key."""
    parts = [df.select(key, (F.lit(float(w)) / (F.col(place) + c)).alias("_s")) for df, w in legs]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).agg(F.sum("_s").alias("score"))


def ladder_decay(df: DataFrame, group: str, newest: Sequence[Column], ladder: Sequence[float] = LADDER) -> DataFrame:
    """df with place (from 0) in its group and weight, the ladder's step for it; the last step holds for all later ones, ungrouped rows weigh 1."""
    step = F.element_at(F.array(*[F.lit(x) for x in ladder]), F.least(F.col("place"), F.lit(len(ladder) - 1)) + 1)
    rows = numbered(df.drop("place"), [group], newest, "place").withColumn("place", F.col("place").cast("int") - 1)
    return rows.withColumn("weight", F.when(F.col(group).isNull(), 1.0).otherwise(step))


def drop_audit(eligible: DataFrame, surfaced: DataFrame, key: str, reason: Column) -> DataFrame:
    """key, reason of what was eligible but didn't surface."""
    return eligible.join(surfaced.select(key), key, "left_anti").select(key, reason.alias("reason"))


def sliding_chunks(docs: DataFrame, doc_id: str, text: str, size: int = 600, overlap: int = 80) -> DataFrame:
    """doc_id, ord, n_words, chunk: windows of `size` words that share `overlap` with the one before; the last may be shorter."""
    words = docs.select(doc_id, F.filter(F.split(F.col(text), "[ \t\n\r]+"), lambda w: w != "").alias("_w")).where(F.size("_w") > 0)
    last = F.ceil(F.greatest(F.size("_w") - size, F.lit(0)) / (size - overlap)).cast("int")
    rows = words.select(doc_id, "_w", F.explode(F.sequence(F.lit(0), last)).alias("ord"))
    own = F.slice("_w", F.col("ord") * (size - overlap) + 1, size)
    return rows.select(doc_id, "ord", F.size(own).alias("n_words"), F.array_join(own, " ").alias("chunk"))


def recurring_lines(docs: DataFrame, doc_id: str, text: str, least: int, min_chars: int = 20) -> DataFrame:
    """line, n_docs of lines (trimmed, min_chars or more) that `least` documents or more hold."""
    lines = docs.select(doc_id, F.explode(F.array_distinct(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)))).alias("line"))
    return lines.where(F.length("line") >= min_chars).groupBy("line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= least)


def ticker_tokens(text: Column, deny: Sequence[str]) -> Column:
    """Words of two to five capitals, each once in the order of first sight, without the denied ones."""
    words = F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda w: w.rlike("^[A-Z]{2,5}$"))
    return F.array_except(words, F.array(*[F.lit(d) for d in deny]))
