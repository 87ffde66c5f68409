"""Folds and searches that SQL can't express, against brute force."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import citations, hypotheses, lifecycle
from siltstone.plans import market
from siltstone.plans import lifecycle as plans  # noqa: F401

SF = "/root/testdata/sf0.001"


def at(day):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)


def test_review_queue(spark):
    rows = [
        (" aa", at(0), "seen", "a"), ("AA", at(1), "seen", "b"), ("AA", at(2), "seen", "a"), ("AA", at(3), "seen", "c"), ("aa", at(4), "seen", "d"),
        ("BB", at(0), "seen", "a"), ("BB", at(1), "dismissed", None), ("BB", at(50), "seen", "a"),
        ("CC", at(0), "seen", None), ("CC", at(1), "dismissed", None), ("CC", at(91), "seen", "x"),
        ("DD", at(0), "dismissed", None), (" ", at(0), "seen", "a"), (None, at(0), "seen", "a"), ("EE", None, "seen", "a"),
    ]
    got = {r.ticker: r for r in lifecycle.review_queue(spark.createDataFrame(rows, "ticker string, ts timestamp, action string, channel string")).collect()}
    assert set(got) == {"AA", "BB", "CC"}
    assert got["AA"].channels == ["b", "c", "d"] and got["AA"].times_seen == 5 and got["AA"].shown
    assert got["BB"].status == "dismissed" and got["BB"].times_seen == 2 and not got["BB"].shown
    assert got["CC"].status == "pending" and got["CC"].resolved_at is None and got["CC"].shown


def test_review_queue_sees_every_event(spark):
    seen = spark.read.parquet(f"{SF}/events.parquet").where("event_type <> 'error'").groupBy(F.concat(F.lit("T"), F.col("user_id") % 97).alias("t")).count()
    got = {r.ticker: r.times_seen for r in market.QUERIES["review_queue"](spark, SF).collect()}
    assert got == {r.t: r["count"] for r in seen.collect()}


def test_beam_search(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vec = {r.vec_id: np.array(r.embedding, float) for r in rows}
    n, q = len(vec), vec[0]
    sim = {k: float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)) for k, v in vec.items()}
    near = {k: set() for k in vec}
    for k in vec:
        for d in ((k * 3 + 1) % n, (k * 5 + 2) % n):
            near[k].add(d)
            near[d].add(k)
    front = sorted(vec, key=lambda k: (-sim[k], k))[:3]
    found, lost = {k: 0 for k in front}, []
    for hop in range(1, 5):
        met = {d for k in front for d in near[k]} - set(found)
        good = sorted((k for k in met if sim[k] >= 0), key=lambda k: (-sim[k], k))
        lost += [(k, hop, "below_prune_threshold") for k in met if sim[k] < 0] + [(k, hop, "beam_overflow") for k in good[5 * len(front) :]]
        front = good[: 5 * len(front)]
        found |= {k: hop for k in front}
    got = market.QUERIES["beam_search"](spark, SF).collect()
    assert {r.node: r.hop for r in got if r.reason is None} == found
    assert sorted((r.node, r.hop, r.reason) for r in got if r.reason) == sorted(lost)


def test_cascade_ends_at_cycles_and_passes(spark):
    rows = [(1, None, "expired"), (2, 1, "active"), (3, 2, "active"), (4, 5, "active"), (5, 4, "active"), (6, 99, "active"), (7, 3, "acted"), (8, None, None), (9, 8, "active")]
    df = spark.createDataFrame(rows, "id long, parent long, status string")
    got = {r.id: r.status for r in hypotheses.cascade(df, "id", "parent", "status").collect()}
    assert got == {1: "expired", 2: "cancelled", 3: "cancelled", 4: "active", 5: "active", 6: "active", 7: "acted", 8: None, 9: "cancelled"}
    got = {r.id: r.status for r in hypotheses.cascade(df, "id", "parent", "status", passes=1).collect()}
    assert got[2] == "cancelled" and got[3] == "active"


def test_spec_errors(spark):
    rows = [(1, "manual", None, None), (2, "nope", None, None), (3, "tv_context_count_since", 0, 1), (4, "tv_context_count_since", 1, 1), (5, None, None, None)]
    df = spark.createDataFrame(rows, "id int, op string, days int, min_count int")
    for c, t in {"symbol": "string", "denominator": "string", "threshold": "double", "sma_days": "int", "window_months": "int", "direction": "string", "stance": "string"}.items():
        df = df.withColumn(c, F.lit(None).cast(t))
    got = {r.id: r.e for r in df.select("id", hypotheses.spec_error().alias("e")).collect()}
    assert got == {1: None, 2: "unknown op", 3: "bad days", 4: None, 5: "unknown op"}


def test_quotes(spark):
    text = "The “owner’s\n earnings” are not what — in most years — is reported."
    cases = {
        'the "owner\'s earnings" are': "match", "owner's earnings…in most years": "match", "in most years ... owner's earnings": "not_found",
        "short": "too_short", "  ": "no_quote", "something else entirely": "not_found",
    }
    df = spark.createDataFrame([(q, text, w) for q, w in cases.items()] + [("long enough a quote", None, "no_chunk_text")], "q string, t string, w string")
    for r in df.select("q", "w", citations.quote_status(F.col("q"), F.col("t")).alias("s")).collect():
        assert r.s == r.w, r.q


def test_disposed_and_rollup(spark):
    df = spark.createDataFrame([(1, "open"), (2, "snoozed"), (3, "acted"), (4, "open")], "id int, status string")
    decisions = spark.createDataFrame([(1, "skipped"), (2, "dismissed"), (3, "dismissed")], "id int, decision string")
    assert {r.id: r.status for r in lifecycle.disposed(df, decisions, "id").collect()} == {1: "acted", 2: "dismissed", 3: "acted", 4: "open"}
    states = spark.createDataFrame([("a", "match"), ("a", "not_found"), ("b", "match"), ("b", "too_short"), ("c", "no_chunk_text"), ("d", "no_quote")], "k string, s string")
    assert {r.k: r.state for r in citations.citation_rollup(states, "k", "s").collect()} == {"a": "mismatch", "b": "verified", "c": "unverifiable", "d": "no_quotes"}


def test_replaced_edges(spark):
    old = spark.createDataFrame([("a", "x", "quote"), ("a", "y", "wikilink"), ("b", "z", "quote")], "src string, dst string, kind string")
    fresh = spark.createDataFrame([("a", "w", "quote")], old.schema)
    got = citations.replace_edges(old, fresh, spark.createDataFrame([("a",)], "path string"), "path", ["quote"])
    assert sorted(map(tuple, got.collect())) == [("a", "w", "quote"), ("a", "y", "wikilink"), ("b", "z", "quote")]
