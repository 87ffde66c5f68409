"""Bundles by a plain fold, communities against all partitions, scopes and globs by fnmatch."""

import fnmatch
import itertools
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import paths
from siltstone.operators import bundles, communities, eligibility
from siltstone.plans import research  # noqa: F401
from siltstone.plans.market import QUERIES

SF = "/root/testdata/sf0.001"


def words(t):
    return len((t or "").split())


def fold(items, cap):
    """One bundle, step by step: (kind, card, at, score, text)."""
    items = sorted(items, key=lambda r: r[2])
    cards = {}
    for r in items:
        if r[0] == "evaluation":
            cards.setdefault(r[1], []).append(r)
    cards = [cards[c] for c in sorted(cards)]
    evidence = [list(r) for r in items if r[0] == "evidence"]
    other = [r for r in items if r[0] not in ("evaluation", "evidence")]
    evidence.sort(key=lambda r: (-float("inf") if r[3] is None else r[3]), reverse=True)
    for _ in range(200):
        n = sum(words(r[4]) for r in [*other, *evidence, *itertools.chain(*cards)])
        if int(n * 1.3) <= cap:
            break
        card = next((c for c in cards if len(c) > 1), None)
        if card:
            card.pop()
        elif len(evidence) > 3:
            low = min(-float("inf") if r[3] is None else r[3] for r in evidence)
            evidence.remove(min((r for r in evidence if (-float("inf") if r[3] is None else r[3]) == low), key=lambda r: r[2]))
        elif evidence:
            longest = max(evidence, key=lambda r: len(r[4] or ""))
            if len(longest[4] or "") <= 50:
                break
            longest[4] = longest[4][: max(50, len(longest[4]) // 2)]
        else:
            break
    return sorted((r[0], r[2], r[4] or "") for r in [*other, *evidence, *itertools.chain(*cards)])


def bundles_of(rng, n):
    out, at = [], 0
    for b in range(n):
        for _ in range(rng.choice([0, 1, 3, 8, 300 if b == 0 else 12])):
            at += 1
            kind = rng.choice(["evaluation", "evaluation", "evidence", "evidence", "evidence", "card"])
            text = rng.choice([None, "", "w " * rng.randrange(60), "long" * 20, " ".join("x" * rng.randrange(1, 9) for _ in range(rng.randrange(200)))])
            out.append((f"b{b}", kind, rng.randrange(3) if kind == "evaluation" else None, at, rng.choice([None, 0.5, 0.25, rng.random()]) if kind == "evidence" else None, text))
    return out


@pytest.mark.parametrize("cap", [0, 40, 300, 5000])
def test_truncation_equals_the_fold(spark, cap):
    rows = bundles_of(random.Random(cap), 12)
    df = spark.createDataFrame([*rows, (None, "evidence", None, 0, 1.0, "no bundle " * 50)], "bundle string, kind string, card int, at long, score double, text string").withColumn("_w", F.lit(1))
    got = {}
    for r in bundles.truncated(df, cap).collect():
        got.setdefault(r.bundle, []).append((r.kind, r.at, r.text or ""))
    assert got.pop(None) == [("evidence", 0, "no bundle " * 50)]
    assert {b: sorted(v) for b, v in got.items()} == {b: fold([r[1:] for r in rows if r[0] == b], cap) for b in {r[0] for r in rows}}


def test_query_of_bundles(spark):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = []
    for s in {r.source for r in docs if r.source is not None}:
        own = [("evaluation" if r.lang == "de" else "evidence", r.doc_id % 4 if r.lang == "de" else None, r.doc_id, float(r.n_chars % 97), r.text) for r in docs if r.source == s]
        want += [(s, k, at, hashlib.sha256(t.encode()).hexdigest()) for k, at, t in fold(own, 6000)]
    got = [tuple(r) for r in QUERIES["bundle_truncation"](spark, SF).where("bundle IS NOT NULL").collect()]
    assert sorted(got) == sorted(want)


def q_of(edges, part):
    m2, inside, degree = 0, 0, {}
    for a, b, w in edges:
        m2 += 2 * w
        inside += 2 * w * (part[a] == part[b])
        for x in (a, b):
            degree[x] = degree.get(x, 0) + w
    sizes = {}
    for x, d in degree.items():
        sizes[part[x]] = sizes.get(part[x], 0) + d
    return inside / m2 - sum(s * s for s in sizes.values()) / m2**2


def partitions(nodes):
    if not nodes:
        yield {}
        return
    for rest in partitions(nodes[1:]):
        groups = sorted(set(rest.values()))
        for g in [*groups, len(groups)]:
            yield {**rest, nodes[0]: g}


def test_louvain_against_all_partitions(spark):
    rng = random.Random(6)
    for _ in range(3):
        edges = [(a, b, rng.randrange(1, 4)) for a, b in itertools.combinations(range(7), 2) if rng.random() < 0.45]
        got = {r.node: r.community for r in communities.louvain(spark.createDataFrame(edges, "src long, dst long, weight long")).collect()}
        nodes = sorted({x for e in edges for x in e[:2]})
        assert sorted(got) == nodes and all(got[got[x]] == got[x] <= x for x in got)
        assert q_of(edges, got) >= max(q_of(edges, p) for p in partitions(nodes)) - 0.05


def test_merging_beats_moves_alone(spark):
    # a ring of 16 small cliques: moves find the cliques, merging joins neighbours where that is better
    edges = [(4 * c + i, 4 * c + j, 1) for c in range(16) for i, j in itertools.combinations(range(4), 2)]
    edges += [(4 * c, 4 * ((c + 1) % 16) + 1, 1) for c in range(16)]
    df = spark.createDataFrame(edges, "src long, dst long, weight long")
    first = communities.modularity(df, communities.communities(df, rounds=10))
    last = communities.modularity(df, communities.louvain(df, rounds=10))
    assert last >= first - 1e-12 and last > 0.7
    assert communities.louvain(df, least_edges=1000).count() == 0 and communities.louvain(df.limit(0)).count() == 0


def test_globs_by_fnmatch(spark):
    names = ["a/b.md", "a/b.txt", "A/b.md", "a\\c.md", "x[1].md", "x1.md", "a/b.md\n", "deep/er/n.md", "", None]
    globs = ["a/*", "*.md", "x[[]1].md", "x[!2].md", "?/b.*", "*er*n*"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    for g in [[x] for x in globs] + [globs, []]:
        got = {r.p: r.m for r in df.select("p", paths.matches_glob(F.col("p"), g).alias("m")).collect()}
        for n in names[:-1]:
            assert got[n] == (any(fnmatch.fnmatchcase(n.replace("\\", "/"), x) for x in g) if g else None), (n, g)
    assert [r[0] for r in df.limit(0).select(paths.in_scope(F.col("p"))).collect()] == []
    one = spark.createDataFrame([("a",), ("ab/c",), ("a/c",), ("a/x/c",), (None,)], "p string")
    assert [r[0] for r in one.select(paths.in_scope(F.col("p"), ["a/"], ["a/x"])).collect()] == [False, False, True, False, False]
    assert [r[0] for r in one.select(paths.in_scope(F.col("p"))).collect()] == [True] * 4 + [False]


def test_eligible_models(spark):
    models = research._models(spark)
    asked = spark.createDataFrame([("BUILDING", "1d", 10), ("BUILDING", "1d", None), ("MACHINERY", "1h", 9999), (None, "1d", 5)], "asset_class string, interval string, bars int")
    got = sorted((r.bars or 0, r.id) for r in eligibility.eligible_models(asked, models).collect())
    assert got == [(0, "bare"), (0, "small"), (10, "bare")]
