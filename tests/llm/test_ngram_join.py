import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from siltstone.llm import ngram_join
from siltstone.llm.common import shared_dir
from siltstone.llm.ngram_join import components, similarity_groups
from tests.llm.cases import ODD, clashing, empty, frame, rows_of, sample

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    w = _WORD.findall((text or "").translate(_LOW))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, num, den):
    """Components over distinct sets, by comparing all sets that share a shingle."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for v in by.values() for k, a in enumerate(v) for b in v[k + 1 :] if min(len(sets[a]), len(sets[b])) * den >= num * max(len(sets[a]), len(sets[b]))}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_against_brute_force(spark, size, num, den):
    docs = sample(spark, "0.01").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows, size, num, den)
    assert rows_of(similarity_groups(docs, size, num, den), "doc_id", "n_shingles", "component_id") == want
    assert len({c for _, _, c in want}) < len(rows)


def test_made_up_chains(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for _ in range(60):
        text = [f"w{x}" for x in rng.integers(0, 400, rng.integers(1, 120))]
        for _ in range(rng.integers(1, 6)):
            rows.append((n, " ".join(text)))
            n += 1
            if rng.random() < 0.7:  # each edit of the last edit: chains of links
                text[rng.integers(0, len(text))] = f"x{rng.integers(0, 50)}"
            if rng.random() < 0.3:
                text.append("end")
    rows += [(n + i, "alpha beta gamma delta epsilon " + f"tail{i % 3}") for i in range(40)]
    rows += [(n + 50 + i, f"one {i % 2}") for i in range(8)]
    docs = frame(spark, rows, 5)
    for size, num, den, long in ((4, 85, 100, 16), (2, 1, 2, 4)):
        assert rows_of(similarity_groups(docs, size, num, den, long), "doc_id", "n_shingles", "component_id") == brute(rows, size, num, den)


def near_copies(rng, first, n, size, edits):
    """n copies of one text, each with its own edits: pairs of them are close to the threshold."""
    text = [f"h{first}x{i}" for i in range(size)]
    rows = []
    for i in range(n):
        own = list(text)
        for at in rng.choice(size, rng.integers(*edits), replace=False):
            own[at] = f"e{rng.integers(0, 1 << 30)}" if rng.random() < 0.7 else f"s{rng.integers(0, 3)}"
        rows.append((first + i, " ".join(own)))
        if rng.random() < 0.1:  # some link to each other, far from the others
            own[int(rng.integers(0, size))] = "z"
            rows.append((first + 100_000 + i, " ".join(own)))
    return rows


@pytest.mark.parametrize(("size", "num", "den", "long"), [(4, 85, 100, 12), (5, 4, 5, 128)])
def test_near_copies_around_a_hub(spark, size, num, den, long):
    rng = np.random.default_rng(11)
    rows = near_copies(rng, 0, 300, 120, (2, 7)) + near_copies(rng, 1_000_000, 80, 40, (0, 3)) + near_copies(rng, 2_000_000, 60, 200, (0, 20))
    docs = frame(spark, rows, 5)
    want = brute(rows, size, num, den)
    assert rows_of(similarity_groups(docs, size, num, den, long), "doc_id", "n_shingles", "component_id") == want
    assert 20 < len({c for _, _, c in want}) < len(rows) - 20


def test_shared_passages(spark):
    """Large sets that share passages with many others, and some near copies of them."""
    rng = np.random.default_rng(7)
    passages = [[f"p{p}x{i}" for i in range(60)] for p in range(6)]
    rows = []
    for i in range(150):
        text = [f"d{i}x{j}" for j in range(int(rng.integers(560, 900)))]
        for p in rng.choice(6, rng.integers(1, 4), replace=False):
            at = int(rng.integers(0, len(text)))
            text[at:at] = passages[p]
        rows.append((i, " ".join(text)))
        if i % 3 == 0:
            for at in rng.choice(len(text), int(rng.integers(5, 40)), replace=False):
                text[at] = "x"
            rows.append((1000 + i, " ".join(text)))
    want = brute(rows, 4, 85, 100)
    assert 150 <= len({c for _, _, c in want}) < len(rows) - 10
    assert rows_of(similarity_groups(frame(spark, rows, 5), 4, 85, 100), "doc_id", "n_shingles", "component_id") == want


def test_odd_rows(spark):
    for docs in (frame(spark), clashing(spark)):
        assert rows_of(similarity_groups(docs, 4, 85, 100), "doc_id", "n_shingles", "component_id") == brute(ODD, 4, 85, 100)
    assert similarity_groups(empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 200) if i % 50] + [(7, 3), (5, 5), (300, 301), (300, 302)]
    got = {r.sid: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for i in range(1, 201):
        assert got[i] == (i - 1) // 50 * 50 + 1
    assert got[302] == got[301] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_pairs_shuffle_only_their_own_texts(spark):
    pack = zstandard.ZstdCompressor().compress
    texts = spark.createDataFrame([(i, pack(f"a{i // 2} b c d e".encode())) for i in range(64)], "sid long, text binary")
    pairs = spark.createDataFrame([(0, 1), (2, 4)], "a long, b long")
    found = ngram_join.verify(pairs, texts, 4, 85, 100)
    assert sorted(map(tuple, found.collect())) == [(0, 1, True), (2, 4, False)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    many = spark.createDataFrame([(i, i + 1) for i in range(0, 64, 2)], "a long, b long")
    assert sorted(map(tuple, ngram_join.verify(many, texts, 4, 85, 100).collect())) == [(i, i + 1, True) for i in range(0, 64, 2)]


def test_all_texts_are_gone_once_the_candidates_are_known(spark, monkeypatch):
    seen, hub_pairs = [], ngram_join._hub_pairs
    there = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:"), "siltstone").glob("*")}
    before = there()
    monkeypatch.setattr(ngram_join, "_hub_pairs", lambda *a: [seen.extend(there() - before), hub_pairs(*a)][1])
    assert similarity_groups(sample(spark, "0.001").select("doc_id", "text"), 4, 85, 100).count()
    assert sorted(x.rpartition("-")[0] for x in seen) == ["candidate-texts", "lists", "set-numbers"]


def test_words_are_hashed_together(monkeypatch):
    """Texts of words that are all new take no digest each, and texts hashed together have the sets that they have alone."""
    made, digest = [], ngram_join.hashlib.blake2b
    monkeypatch.setattr(ngram_join.hashlib, "blake2b", lambda *a, **how: [made.append(1), digest(*a, **how)][1])
    texts = [" ".join(f"w{i}x{j}" for j in range(500)) for i in range(40)]
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": texts})
    rows = [r for b in ngram_join._sets(4)([docs]) for r in b.to_pylist() if r["n"] is not None]
    assert [r["n"] for r in rows] == [497] * 40 and len({r["sig"] for r in rows}) == 40
    assert len(made) <= 40, len(made)

    rng = np.random.default_rng(5)
    words = ["a", "a\0", "a\0\0", "é", "b" * 8, "b" * 9, "b" * 16, "c" * 64, "c" * 65, "c" * 500, "c" * 499 + "d", "\x1c", "\xa0", "\0"]
    gaps = [" ", "  ", "\t", "\n", "\r\n", "\v", "\f"]
    odd = ["", " ", "\n\t", "one", " two words ", "four words are here", *("".join(words[w] + gaps[g] for w, g in zip(rng.integers(0, len(words), n), rng.integers(0, len(gaps), n), strict=True)) for n in rng.integers(1, 60, 300))]
    together = list(ngram_join.shingled((t.encode() for t in odd), 4))
    assert [t.decode() for t, _ in together] == odd
    for text, (_, own) in zip(odd, together, strict=True):
        assert len(own) == len(shingles(text, 4)) and (np.diff(own.astype(object)) > 0).all()
        ((_, alone),) = ngram_join.shingled([text.encode()], 4)
        assert alone.tolist() == own.tolist()
    parts = {s: h for text, (_, own) in zip(odd, together, strict=True) if len(shingles(text, 4)) == 1 for s, h in zip(shingles(text, 4), own.tolist(), strict=True)}
    assert len(set(parts.values())) == len(parts) > 5
