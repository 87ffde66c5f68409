"""Centrality and communities of an undirected graph, by rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.shared import settled


def undirected(edges: DataFrame) -> DataFrame:
    """src, dst, weight in both directions, weights of one pair added up; loops are left out."""
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")).where("src <> dst")
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def eigenvector_centrality(edges: DataFrame, rounds: int) -> DataFrame:
    """node, centrality after so many rounds of x <- (A + I) x, scaled to length 1; starts even."""
    way = settled(undirected(edges), "ways")
    nodes = way.select(F.col("src").alias("node")).distinct()
    x = nodes.withColumn("centrality", F.lit(1.0))
    for _ in range(rounds):
        sent = way.join(x, way.src == x.node).select(F.col("dst").alias("node"), (F.col("weight") * F.col("centrality")).alias("_x"))
        y = sent.unionByName(x.withColumnRenamed("centrality", "_x")).groupBy("node").agg(F.sum("_x").alias("_x"))
        y = settled(y, "centrality")
        norm = F.broadcast(y.agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_norm")))
        x = y.join(norm).select("node", (F.col("_x") / F.col("_norm")).alias("centrality"))
    return x


def communities(edges: DataFrame, rounds: int = 20, seed: int = 42) -> DataFrame:
    """node, community (its smallest node) by local moves that raise modularity, as in Louvain's first phase.

    Each round, a pseudo-random half of the nodes may move to the neighbouring community of the largest gain
    (ties: the smallest name), all from the same state; the best state of all rounds, by modularity, is returned.
    A round is three joins and two aggregates; nothing is gathered in one task. Community totals are pre-aggregated,
    so a hub or a huge community is one row wherever it is joined.
    """
    way, degree, total = _graph(edges)
    best, _ = _local_moves(way, degree, total, 0.0, rounds, seed)
    return _named(best, best.select("node", "community"))


def louvain(edges: DataFrame, rounds: int = 12, levels: int = 10, seed: int = 42, least_edges: int = 0) -> DataFrame:
    """node, community (its smallest node) by local moves and merging in turn, until modularity stops rising.

    On each level the communities of the last one are nodes: links between two of them are added up, and links inside stay
    with them as a loop, which counts in their degree. Merging two communities can raise modularity where moving single nodes can't.
    Graphs of fewer than least_edges pairs of nodes give no rows. Nothing is gathered in one task; a level has as many nodes as the last one
    has communities.
    """
    way, degree, total = _graph(edges)
    if least_edges and way.count() < 2 * least_edges:
        return degree.select("node", F.col("node").alias("community")).limit(0)
    member, inner, reached = degree.select("node", F.col("node").alias("community")), 0.0, None
    for level in range(levels):
        state, q = _local_moves(way, degree, total, inner, rounds, seed + 1000 * level)
        if reached is not None and q <= reached + 1e-12:
            break
        reached = q
        up = state.select(F.col("node").alias("community"), F.col("community").alias("_up"))
        member = settled(member.join(up, "community").select("node", F.col("_up").alias("community")), "members")
        a = state.select(F.col("node").alias("src"), F.col("community").alias("_a"))
        b = state.select(F.col("node").alias("dst"), F.col("community").alias("_b"))
        drawn = settled(way.join(a, "src").join(b, "dst").groupBy(F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(F.sum("weight").alias("weight")), "merged-ways")
        inner += drawn.where("src = dst").agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("x")).first()["x"]
        way = drawn.where("src <> dst")
        degree = settled(state.groupBy(F.col("community").alias("node")).agg(F.sum("degree").alias("degree")), "merged-degrees")
        if way.isEmpty():
            break
    return _named(member, member)


def _graph(edges: DataFrame) -> tuple[DataFrame, DataFrame, float | None]:
    """Links both ways, degrees of the nodes, and their sum (null without links)."""
    way = settled(undirected(edges), "ways")
    degree = settled(way.groupBy("src").agg(F.sum("weight").cast("double").alias("degree")).withColumnRenamed("src", "node"), "degrees")
    return way, degree, degree.agg(F.sum("degree").alias("m2")).first()["m2"]


def _named(members: DataFrame, state: DataFrame) -> DataFrame:
    names = members.groupBy("community").agg(F.min("node").alias("_name"))
    return state.join(names, "community").select("node", F.col("_name").alias("community"))


def _local_moves(way: DataFrame, degree: DataFrame, total: float | None, inner: float, rounds: int, seed: int) -> tuple[DataFrame, float]:
    """The best state (node, degree, community) of so many rounds, and its modularity; inner: the weight of loops, which no move changes."""
    state = settled(degree.withColumn("community", F.col("node")), "communities")
    if not total:
        return state, 0.0
    best, best_q = state, _modularity(way, state, total) + inner / total
    for k in range(rounds):
        sizes = state.groupBy("community").agg(F.sum("degree").alias("_size"))
        side = state.select(F.col("node").alias("dst"), "community")
        links = way.join(side, "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("weight").alias("_in"))
        own = state.select("node", "degree", F.col("community").alias("_own"))
        turn = F.pmod(F.xxhash64("node", F.lit(seed + k)), F.lit(2)) == 0
        options = links.join(own.where(turn), "node").join(sizes, "community")
        # the node itself doesn't count in its own community's total
        others = F.col("_size") - F.when(F.col("community") == F.col("_own"), F.col("degree")).otherwise(0.0)
        gain = F.round(F.col("_in") - F.col("degree") * others / total, 9)
        stays = F.max(F.when(F.col("community") == F.col("_own"), gain))
        # a node without a link into its own community gains nothing by staying, less what its degree costs there
        alone = own.where(turn).join(sizes.withColumnRenamed("community", "_own"), "_own")
        base = alone.select("node", (-F.col("degree") * (F.col("_size") - F.col("degree")) / total).alias("_base"))
        pick = options.groupBy("node").agg(F.max_by("community", F.struct(gain, F.col("community") == F.col("_own"))).alias("_new"), F.max(gain).alias("_gain"), stays.alias("_stay"))
        moves = pick.join(base, "node").where(F.col("_gain") > F.coalesce("_stay", F.round("_base", 9))).select("node", "_new")
        new = settled(state.join(moves, "node", "left").select("node", "degree", F.coalesce("_new", "community").alias("community")), "communities")
        q = _modularity(way, new, total) + inner / total
        if q > best_q:
            best, best_q = new, q
        state = new
    return best, best_q


def _modularity(way: DataFrame, state: DataFrame, total: float) -> float:
    """Modularity of a state: one number of two small aggregates."""
    a = state.select(F.col("node").alias("src"), F.col("community").alias("_a"))
    b = state.select(F.col("node").alias("dst"), F.col("community").alias("_b"))
    inside = way.join(a, "src").join(b, "dst").where("_a = _b").agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("x")).first()["x"]
    square = state.groupBy("community").agg(F.sum("degree").alias("_s")).agg(F.sum(F.col("_s") * F.col("_s")).alias("x")).first()["x"]
    return inside / total - square / total**2


def modularity(edges: DataFrame, groups: DataFrame) -> float:
    """Modularity of groups (node, community)."""
    way = undirected(edges)
    degree = way.groupBy(F.col("src").alias("node")).agg(F.sum("weight").cast("double").alias("degree"))
    total = degree.agg(F.sum("degree").alias("m2")).first()["m2"]
    return _modularity(way, groups.join(degree, "node"), total) if total else 0.0


def new_clusters(now: DataFrame, before: DataFrame, scores: DataFrame, least: int = 3) -> DataFrame:
    """community, n_nodes, representative of clusters (node, community) of `least` nodes or more that lie in no earlier one.

    The representative has the greatest centrality, then pagerank, then the smallest name. A cluster lies in an
    earlier one if all its nodes do: nodes shared by a pair of clusters are counted against the new one's size.
    """
    sized = now.groupBy("community").agg(F.count(F.lit(1)).alias("n_nodes")).where(F.col("n_nodes") >= least)
    old = before.select("node", F.col("community").alias("_old"))
    inside = now.join(old, "node").groupBy("community", "_old").agg(F.count(F.lit(1)).alias("_n")).groupBy("community").agg(F.max("_n").alias("_n"))
    fresh = sized.join(inside, "community", "left").where(F.coalesce("_n", F.lit(0)) < F.col("n_nodes")).select("community", "n_nodes")
    ranked = now.join(fresh.select("community"), "community").join(scores, "node", "left")
    key = F.struct(-F.coalesce("centrality", F.lit(0.0)), -F.coalesce("pagerank", F.lit(0.0)), "node")
    head = ranked.groupBy("community").agg(F.min(key)["node"].alias("representative"))
    return fresh.join(head, "community")
