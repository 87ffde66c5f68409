"""Neighbourhoods against a plain search, without a distinct table of all edges."""

import random

from siltstone.operators import graph


def test_neighbourhood_by_a_plain_search(spark, monkeypatch):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)] * 3 + [("n0", "n0"), ("n0", "n1")]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, front = {"n0": 0}, {"n0"}
    for k in (1, 2, 3):
        front = {b for a in front for b in near[a]} - want.keys()
        want |= dict.fromkeys(front, k)
    plans, write = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    edges = spark.createDataFrame(pairs, "src string, dst string")
    got = graph.neighbourhood(edges, spark.createDataFrame([("n0",), ("n0",)], "node string"), 3).collect()
    assert {r.node: r.hops for r in got} == want and len(got) == len(want)
    assert "Aggregate" not in plans[0]
    assert "Aggregate" not in graph.both_ways(edges)._jdf.queryExecution().optimizedPlan().toString()
