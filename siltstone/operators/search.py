"""Search over a graph of documents: re-ranking by graph scores, and a beam that follows links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import notes
from siltstone.operators.graph import both_ways
from siltstone.operators.retrieval import cosine
from siltstone.shared import settled


def hybrid_rerank(results: DataFrame, nodes: DataFrame, key: str, now: Column, n_edges: int, alpha: float, beta: float, gamma: float, recent: float = 0.05, recent_days: int = 30, min_edges: int = 10) -> DataFrame:
    """results (key, score) with hybrid_score: alpha * score + beta * citation_rank + gamma * centrality + recent.

    The weight of a missing graph score goes to alpha. recent counts for nodes published (else ingested) in the last
    recent_days. With fewer than min_edges edges the results come back as they are.
    """
    if n_edges < min_edges:
        return results
    met = results.join(nodes.select(key, "citation_rank", "centrality", F.coalesce("published_at", "ingested_at").alias("_day")), key, "left")
    rank, central = F.col("citation_rank"), F.col("centrality")
    weight = F.lit(alpha) + F.when(rank.isNull(), beta).otherwise(0.0) + F.when(central.isNull(), gamma).otherwise(0.0)
    new = F.when(F.datediff(now, "_day").between(0, recent_days), recent).otherwise(0.0)
    score = weight * F.coalesce("score", F.lit(0.0)) + beta * F.coalesce(rank, F.lit(0.0)) + gamma * F.coalesce(central, F.lit(0.0)) + new
    return met.select(*results.columns, score.alias("hybrid_score"))


def composed(
    chunks: DataFrame, nodes: DataFrame, hits: DataFrame, terms: Sequence[str], fields: Sequence[str], k: int, allowed: Column | None = None, least_terms: int = 2, weights: tuple[float, float] = (1.0, 0.5), c: int = 60, **decay
) -> DataFrame:
    """node, ord, similarity, decay_weight, score, lexical_only, place of the first k chunks for a question, by vectors and words together.

    chunks: node, ord and the fields that words are looked for in. nodes: node and what allowed and decay need. hits: node, ord and
    similarity of the nearest chunks, fetched beyond k (vector_index.overfetch). Both legs keep only nodes that are allowed, by the
    question's anchors. Of the words' leg, max(4k, 24) chunks count, if the question has least_terms terms. Each leg's places make
    the order, weight / (c + place); chunks that only words find come behind all others, with 1 / (1 + BM25) as similarity. The
    decay (of notes.decayed: group, newest, kind, evergreen, floor, overrides) is worked out over all nodes of both legs,
    and what it brings to zero goes; score is similarity times decay. The legs have as many rows as were fetched, whatever the tables hold.
    """
    known = nodes if allowed is None else nodes.where(allowed)
    pool = settled(hits.select("node", "ord", "similarity").join(known, "node"), "vector-leg")
    columns = [x for x in pool.columns if x not in ("node", "ord", "similarity")]

    def weighed(rows: DataFrame) -> DataFrame:
        return notes.decayed(rows.select("node", *columns).dropDuplicates(["node"]), **decay).select("node", F.col("weight").alias("decay_weight"))

    first = pool.join(weighed(pool), "node").withColumn("score", F.col("similarity") * F.col("decay_weight"))
    # from here on all tables are as short as what was fetched
    one = Window.orderBy(F.desc("score"), "node", "ord")
    placed = first.select("node", "ord", "similarity", (F.row_number().over(one) - 1).alias("_v"))
    if len(terms) < least_terms:
        out = first.select("node", "ord", "similarity", "decay_weight", "score", F.lit(False).alias("lexical_only"))
        return out.withColumn("place", F.row_number().over(one)).where(F.col("place") <= k)
    found = notes.lexical(chunks.select(F.struct("node", "ord").alias("_key"), *fields), "_key", list(fields), terms)
    found = found.select("_key.node", "_key.ord", "score", "lexical_score").join(known, "node")
    found = settled(found.orderBy(F.desc(F.round("score", 9)), "node", "ord").limit(max(4 * k, 24)), "word-leg")
    words = found.select("node", "ord", "lexical_score", (F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "node", "ord")) - 1).alias("_l"))
    both = placed.join(words, ["node", "ord"], "full")
    rrf = F.coalesce(weights[0] / (c + F.col("_v")), F.lit(0.0)) + F.coalesce(weights[1] / (c + F.col("_l")), F.lit(0.0))
    again = weighed(pool.select("node", *columns).unionByName(found.select("node", *columns)))
    similarity = F.coalesce("similarity", "lexical_score")
    rows = both.withColumn("_rrf", F.round(rrf, 12)).join(again, "node")
    rows = rows.select("node", "ord", similarity.alias("similarity"), "decay_weight", (similarity * F.col("decay_weight")).alias("score"), F.col("_v").isNull().alias("lexical_only"), "_rrf")
    order = Window.orderBy("lexical_only", F.desc("_rrf"), "node", "ord")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("_rrf")


def beam_search(edges: DataFrame, vectors: DataFrame, node: str, vector: str, query: Sequence[float], seeds: int = 3, hops: int = 4, width: int = 5, prune: float = 0.5, target: int = 10, quality: float | None = 0.65) -> tuple[DataFrame, DataFrame]:
    """Two tables: found (node, similarity, hop) and rejected (node, similarity, hop, reason).

    Starts from the `seeds` nodes nearest to the query (a node's similarity is its best vector's) and follows edges in
    both directions. Of each hop's unseen neighbours those below `prune` are rejected as below_prune_threshold, those
    beyond width times the frontier as beam_overflow. Ends when no neighbour is left, after `hops`, or when `target`
    nodes with a mean of `quality` are found (None: never). Found nodes number seeds * (width + 1) ** hops at most,
    which bounds what is broadcast; neighbours are joined, never collected.
    """
    near = cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    way = both_ways(edges)
    scored = vectors.select(F.col(node).alias("node"), near.alias("similarity")).where("similarity is not null")
    best = scored.groupBy("node").agg(F.max("similarity").alias("similarity"))
    order = [F.desc("similarity"), "node"]
    front = settled(best.orderBy(*order).limit(seeds).withColumn("hop", F.lit(0)), "beam")
    found, rejected, size = front, front.limit(0).withColumn("reason", F.lit("")), front.count()
    for hop in range(1, hops + 1):
        if size == 0:
            break
        next_ = way.join(F.broadcast(front.select(F.col("node").alias("src"))), "src").select(F.col("dst").alias("node")).distinct()
        next_ = next_.join(F.broadcast(found.select("node")), "node", "left_anti")
        met = settled(scored.join(next_, "node").groupBy("node").agg(F.max("similarity").alias("similarity")).withColumn("hop", F.lit(hop)), "met")
        good = met.where(F.col("similarity") >= prune)
        front = settled(good.orderBy(*order).limit(width * size), "beam")
        over = good.join(F.broadcast(front.select("node")), "node", "left_anti").withColumn("reason", F.lit("beam_overflow"))
        low = met.where(F.col("similarity") < prune).withColumn("reason", F.lit("below_prune_threshold"))
        rejected = rejected.unionByName(low).unionByName(over)
        found, size = found.unionByName(front), front.count()
        stats = found.agg(F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("mean")).first()
        if quality is not None and stats["n"] >= target and stats["mean"] >= quality:
            break
    return found, rejected
