import hashlib
import random
import time
import zlib
from fractions import Fraction

from siltstone.llm.periodic_runs import WORD, collapsed, find_runs, greatest, periodic_runs
from siltstone.llm.queries import op12_periodic_runs, with_loops
from tests.llm.cases import ODD, clashing, empty, frame, sample


def brute_force(w, least=6, exponent=4):
    """All runs, period by period."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                f = w[i : i + length]
                if not any(f[d:] == f[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_up(rng):
    docs = []
    for _ in range(rng.randrange(6)):
        k, n = rng.choice([1, 2, 2, 3, 8]), rng.choice([0, 1, 3, 5, 6, 10, 40, 120])
        d = [str(rng.randrange(k)) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // (3 + rng.randrange(8))
            d = [d[i] if i < a else d[a + (i - a) % p] for i in range(n)]
        docs.append(d * 5 if rng.random() < 0.3 else d)
    return docs


def test_runs_by_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        docs = made_up(rng)
        for exponent, least in ((4, 6), (3, 3), (5, 12)):
            assert find_runs(docs, least, exponent) == [brute_force(d, least, exponent) for d in docs]


def test_words_of_fibonacci_and_of_thue_morse():
    # no Fibonacci word has a fourth power, no Thue-Morse word a cube
    a, b, t = "a", "ab", "a"
    for _ in range(14):
        a, b = b, b + a
    for _ in range(11):
        t += "".join("b" if c == "a" else "a" for c in t)
    assert find_runs([list(b)], 3, 4) == [[]] and find_runs([list(t)], 3, 3) == [[]]
    cubes = find_runs([list(b[:1500])], 3, 3)[0]
    assert cubes == brute_force(list(b[:1500]), 3, 3) and {q for *_, q in cubes} <= {1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377}


def test_long_runs_in_time():
    rng = random.Random(1)
    period = [str(rng.randrange(50)) for _ in range(3000)]
    docs = [["word"] * 60_000, period * 6, [str(rng.randrange(5000)) for _ in range(100_000)]]
    began = time.time()
    assert find_runs(docs) == [[(0, 60_000, 1)], [(0, 18_000, 3000)], []]
    assert time.time() - began < 60


def test_greatest_is_exact_and_collapsing():
    runs = [(0, 9, 2), (5, 18, 4), (1, 9, 2), (0, 40, 10)]
    assert greatest(runs) == max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) == (0, 9, 2)
    assert greatest([(0, 10**17 + 1, 10**16), (3, 10**17 + 2, 10**16)])[0] == 3
    assert greatest([]) is None
    assert collapsed(list("xababababy"), [(1, 8, 2)]) == list("xaby")
    assert collapsed(list("aaaaaabababab"), [(0, 6, 1), (5, 8, 2)]) == list("ab")


def test_query_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in sample(spark).collect()}
    found = op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(texts) and sum(r.n_runs > 0 for r in found) > 5
    for r in found:
        words = WORD.findall(texts[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_force(words)
        dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()


def test_odd_rows(spark):
    got = {(r.doc_id, r.collapsed): r for r in periodic_runs(clashing(spark)).collect()}
    assert got[7, "word"].runs[0].asDict() == {"start": 0, "length": 60_000, "period": 1}
    for key in ((1, ""), (2, ""), (3, ""), (None, "")):
        assert (got[key].n_words, got[key].runs, got[key].top) == (0, [], None)
    assert periodic_runs(frame(spark)).count() == len(ODD) and periodic_runs(empty(spark)).count() == 0
    assert with_loops(None, ["a", "b"]) == ["a", "b"] and with_loops(5, []) == []
