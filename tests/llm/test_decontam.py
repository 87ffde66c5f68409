import hashlib

import numpy as np

from siltstone.llm.decontam import FMIndex, WaveletMatrix, brute_force, decontaminate, find_contamination, merged_spans
from tests.llm.cases import ODD, clashing, empty, frame, sample

BENCH = "item_id long, text string"


def as_row(n_words, hit, items):
    n_hit = sum(hit)
    return (n_words, n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words)


COLUMNS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_wavelet_ranks():
    rng = np.random.default_rng(0)
    row = rng.integers(0, 13, 500).astype(np.int32)
    m = WaveletMatrix(row, 4)
    for c in range(13):
        at = rng.integers(0, 501, 30)
        assert m.rank(np.full(30, c), at).tolist() == [int((row[:i] == c).sum()) for i in at]


def test_fm_index_finds_all_places():
    rng = np.random.default_rng(1)
    for _ in range(30):
        runs = [rng.integers(1, 4, rng.integers(1, 30)).tolist() for _ in range(rng.integers(1, 8))]
        row = np.array([x for r in runs for x in (*r, 0)], np.int32)
        index = FMIndex(row, sample=3)
        patterns = [tuple(rng.integers(1, 5, rng.integers(1, 6)).tolist()) for _ in range(20)]
        width = max(map(len, patterns))
        filled = np.array([[*p, *[0] * (width - len(p))] for p in patterns], np.int32)
        lo, hi = index.ranges(filled, np.array([len(p) for p in patterns]))
        for p, a, b in zip(patterns, lo, hi, strict=True):
            want = [i for i in range(len(row)) if tuple(row[i : i + len(p)].tolist()) == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_against_brute_force(spark):
    docs = sample(spark, "0.01").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rows = [tuple(r) for r in docs.collect()]
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    want = dict(zip((i for i, _ in rows), brute_force([t for _, t in rows], items), strict=True))
    got = decontaminate(docs, bench).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == as_row(*want[r.doc_id])
        assert [(s["first"], s["end"]) for s in r.word_spans] == merged_spans(np.array(want[r.doc_id][1], bool))
    assert any(r.contaminated for r in got)


def test_blocks_of_the_benchmark(spark):
    docs = clashing(spark, ODD + [(20, "a b c d e f g h i j k l m n o p"), (21, "x a b c y d e f"), (22, "x a b c y d e f")])
    bench = spark.createDataFrame([(1, "a b c"), (2, "d e f g h i j k l m n o p q r"), (3, "plain words only"), (3, "plain words only"), (4, None), (5, ""), (None, "plain"), (10, "c d"), (6, "y")], BENCH)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(str(r.item_id), r.text) for r in bench.collect() if r.item_id is not None]
    for block in (1 << 20, 8):
        got = sorted(map(repr, ((r.doc_id, r.n_words, [(s["first"], s["end"]) for s in r.word_spans], r["items"]) for r in find_contamination(docs, bench, 13, block).collect())))
        want = [(i, n, merged_spans(np.array(hit, bool)), found) for (i, _), (n, hit, found) in zip(rows, brute_force([t for _, t in rows], items), strict=True)]
        assert got == sorted(map(repr, want)), block


def test_no_benchmark_and_no_documents(spark):
    none = spark.createDataFrame([], BENCH)
    assert decontaminate(frame(spark), none).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate(empty(spark), none).count() == 0
