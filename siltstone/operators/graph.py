"""Graphs as edge tables (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.shared import settled


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; repeats stay, so no task has to hold the edges."""
    return edges.select("src", "dst").union(edges.select("dst", "src"))


def pagerank(edges: DataFrame, rounds: int, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """node, rank after so many rounds, or after the first that changes ranks by tolerance a node at most, all told.

    What nodes without outgoing edges hold is spread over all nodes. Each round's ranks are a table in the shared folder, so
    plans don't grow with the rounds.
    """
    edges = settled(edges.select("src", "dst", "weight"), "graph-edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    n = F.broadcast(nodes.agg(F.count(F.lit(1)).alias("_n")))
    out = edges.groupBy("src").agg(F.sum("weight").alias("_out"))
    share = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_out")).alias("share"))
    ranks = nodes.join(n).select("node", (1.0 / F.col("_n")).alias("rank"))
    for _ in range(rounds):
        sent = share.join(ranks, share.src == ranks.node).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("_in"))
        lost = ranks.join(out, ranks.node == out.src, "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("_lost"))
        new = (1 - damping) / F.col("_n") + damping * (F.coalesce("_in", F.lit(0.0)) + F.col("_lost") / F.col("_n"))
        ranks = ranks.withColumnRenamed("rank", "_old")
        ranks = ranks.join(sent, ranks.node == sent.dst, "left").join(n).join(F.broadcast(lost)).select("node", "_old", new.alias("rank"))
        step = settled(ranks, "ranks")
        ranks = step.select("node", "rank")
        if tolerance is not None:
            moved, count = step.agg(F.sum(F.abs(F.col("rank") - F.col("_old"))), F.count(F.lit(1))).first()
            if (moved or 0.0) <= tolerance * count:
                break
    return ranks


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, hops of all nodes within `depth` edges of the start nodes, edges counting in both directions.

    Edges may repeat: only what a front meets is made distinct, so tasks hold nodes, never the edges.
    """
    way = both_ways(settled(edges.select("src", "dst"), "edges"))
    seen = start.select("node", F.lit(0).alias("hops")).distinct()
    front = seen
    for k in range(1, depth + 1):
        near = front.join(way, front.node == way.src).select(F.col("dst").alias("node")).distinct()
        front = settled(near.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(k)), "front")
        seen = seen.unionByName(front)
    return seen


def ancestors(paths: DataFrame, path: str) -> DataFrame:
    """path, folder, depth (from 1) of each folder above a path, the root's first."""
    parts = F.split(F.col(path), "/")
    deep = paths.select(path, parts.alias("_p")).where(F.size("_p") > 1)
    rows = deep.select(path, "_p", F.explode(F.sequence(F.lit(1), F.size("_p") - 1)).alias("depth"))
    return rows.select(path, F.array_join(F.slice("_p", 1, F.col("depth")), "/").alias("folder"), "depth")
