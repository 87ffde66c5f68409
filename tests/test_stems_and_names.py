"""Stems by published pairs, BM25 over stems and near-duplicate names by brute force."""

import math
import random
import re
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.functions.stems import stem, words
from siltstone.operators import names, stemmed
from siltstone.plans import discovery
from siltstone.plans.market import QUERIES

SF = "/root/testdata/sf0.001"
#: Examples of the published algorithm, step by step: word and stem (fixed values).
PUBLISHED = """
    caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
    conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file
    happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform
    radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
    decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic
    formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow
    inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
    dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect
    bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil
""".split()


@pytest.mark.parametrize("word,want", list(zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True)))
def test_published_stems(word, want):
    assert stem(word) == want


def test_words_without_marks():
    assert words("Café_ÉTÉ naïve 東京 Straße\n") == ["cafe", "ete", "naive", "東京", "straße"]
    assert words(None) == words(" _ ") == []
    assert [stem(w) for w in ("is", "東京s", "x" * 63 + "s", "x" * 64 + "s")] == ["is", "東京s", "x" * 63, "x" * 64 + "s"]


def plain_bm25(docs, question):
    rows = {d: [stem(w) for w in words(t)] for d, t in docs}
    n, avg = len(rows), sum(map(len, rows.values())) / len(rows)
    out = {}
    for s in {stem(w) for q in question for w in words(q)}:
        df = sum(s in r for r in rows.values())
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        for d, r in rows.items():
            if tf := r.count(s):
                out[d] = out.get(d, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(r) / avg))
    return out


def test_bm25_over_stems(spark):
    docs = [(1, "Connected cafés connect connections"), (2, "nothing here"), (3, None), (4, ""), (5, "CONNECTING the Café"), (6, "relate relational " * 50)]
    df = spark.createDataFrame([*docs, (None, "connect")], "doc_id long, text string").withColumn("word", F.lit(1))
    for question in (["connection"], ["Cafes", "relating", "relate"], ["absent"]):
        got = {r.doc_id: r.score for r in stemmed.bm25_stems(df, "doc_id", "text", question).collect()}
        want = plain_bm25(docs, question)
        assert got.keys() == want.keys() and all(math.isclose(got[d], want[d]) for d in want)


def test_counts_come_in_small_batches():
    """However many texts a batch has; those of one text may be more."""
    texts = [" ".join(f"w{i}x{j}" for j in range(500)) for i in range(300)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(302), pa.int64()), pa.array(texts)], ["id", "text"])
    out = list(stemmed._counted([batch]))
    assert max(b.num_rows for b in out) < 20_000
    assert [(r["id"], r["word"], r["n"], r["length"]) for b in out for r in b.to_pylist()] == [(i, f"w{i}x{j}", 1, 500) for i in range(300) for j in range(500)]


def test_query_over_stems(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted(((-round(s, 5), d) for d, s in plain_bm25(docs, discovery._QUESTION).items()))[:20]
    got = [(-r.score, r.doc_id) for r in QUERIES["bm25_stems_topk"](spark, SF).collect()]
    assert [d for _, d in got] == [d for _, d in want] and all(math.isclose(a, b, abs_tol=2e-5) for (a, _), (b, _) in zip(got, want, strict=True))


def all_pairs(found, ratio):
    found = sorted({n for n in found if n and "/" not in n})
    out = {}
    for i, a in enumerate(found):
        for b in found[i + 1 :]:
            if 2 * min(len(a), len(b)) >= ratio * (len(a) + len(b)) and (r := SequenceMatcher(None, a, b).ratio()) >= ratio:
                out[a, b] = r
    return out


def test_near_duplicate_names_by_all_pairs(spark):
    rng = random.Random(3)
    texts = " ".join(r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())
    some = rng.sample(sorted({w for w in re.findall(r"[a-z]{3,}", texts)}), 1700)
    some += ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    some += [f"{w[:3]}{rng.choice('-xyz')}{w[3:]}" for w in some[:300]] + ["x/y", "x/yz", None, ""]
    df = spark.createDataFrame([(n,) for n in some], "n string").withColumn("name", F.lit(0))
    for ratio in (0.85, 0.7):
        want = all_pairs([n for n in some if n], ratio)
        got = {(r.a, r.b): r.ratio for r in names.near_duplicates(df, "n", ratio).collect()}
        assert got == want
    distinct = df.select(F.col("n").alias("name")).where("name > '' and not contains(name, '/')").distinct()
    met, found = names.candidates(distinct, 0.85).count(), len(all_pairs([n for n in some if n], 0.85))
    assert found > 200 and met < 60 * found, (met, found)  # a hundredth of all pairs


def test_query_of_names(spark):
    targets = {t for r in spark.read.parquet(f"{SF}/pages.parquet").collect() for t in re.findall(r'href="/([^"]*)"', r.html or "")}
    got = {(r.a, r.b): r.ratio for r in QUERIES["near_duplicate_names"](spark, SF).collect()}
    assert got == all_pairs(targets, 0.85) and got


def test_known_aliases_and_the_first_suggestions(spark):
    df = spark.createDataFrame([("zone2",), ("zone-2",), ("risk-parity",), ("risk-parity-strategy",), ("Zone 2 cardio",), ("zone 2 cardio",)], "n string")
    aliases = spark.createDataFrame([("zone2", "zone-2")], "alias string, target string")
    assert [(r.a, r.b) for r in names.top_suggestions(names.near_duplicates(df, "n")).collect()] == [("Zone 2 cardio", "zone 2 cardio"), ("zone-2", "zone2")]
    assert [(r.a, r.b) for r in names.near_duplicates(df, "n", aliases=aliases).collect()] == [("Zone 2 cardio", "zone 2 cardio")]
    assert names.near_duplicates(df.limit(0), "n").count() == 0
    with pytest.raises(ValueError):
        names.near_duplicates(df, "n", 0.5)


def test_texts_go_to_python_a_few_megabytes_at_once(spark, monkeypatch):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array(["x"]), pa.array([b.nbytes], pa.int64()), pa.array([0], pa.int64())], ["id", "word", "n", "length"])

    monkeypatch.setattr(stemmed, "_counted", sizes)
    docs = spark.range(3000).repartition(1).select("id", F.repeat(F.lit("word "), 1000).alias("text"))
    got = stemmed.word_counts(docs, "id", "text").collect()
    assert sum(r.id for r in got) == 3000 and max(r.n for r in got) < 8e6
