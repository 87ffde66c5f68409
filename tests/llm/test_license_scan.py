import re

from siltstone.llm.license_scan import BASE, NOTICES, NoticeFinder, license_scan, words_line
from tests.llm.cases import ODD, clashing, empty, rows_of, sample

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute(text):
    words = _WORD.findall((text or "").translate(_LOW))
    at = []
    for phrase, label in BASE.items():
        p = phrase.split()
        at += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_base_against_brute_force(spark):
    docs = sample(spark, "0.01")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = license_scan(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base)
    assert any(r.n_base for r in got)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edited_notices():
    finder = NoticeFinder()
    for phrase, label in NOTICES.items():
        k = len(phrase) // 12
        for text in (phrase, phrase.replace("e", "x", min(k, 2)), phrase[1:], phrase.upper() + "!"):
            found = finder.find(words_line("some words before " + text + " and after"))
            assert label in {x[0] for x in found}, text
    assert finder.find(words_line("nothing of the kind stands here, rights are wrong")) == []


def test_edits_are_bounded():
    finder = NoticeFinder({"all rights reserved": "reserved"})  # one edit
    for text, hit in (("all rights reserved", 1), ("all right reserved", 1), ("al rights reservd", 0), ("all rigths reserved", 0), ("allrights reserved", 1)):
        line = words_line("x " + text + " y")
        found = finder.find(line)
        assert len(found) == hit, text
        for _, a, b, edits, _ in found:
            assert distance(line[a:b].decode(), "all rights reserved") == edits <= 1


def test_odd_rows(spark):
    got = license_scan(clashing(spark))
    assert [r[0] for r in rows_of(got, "doc_id")] == sorted((i for i, _ in ODD), key=lambda x: (x is not None, x))
    for r in got.where("doc_id <= 2").collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels, r.score) == (0, 0, None, None, "", 0.0)
    assert license_scan(empty(spark)).count() == 0


def test_long_repetitive_text_takes_linear_time():
    import time

    from siltstone.llm.license_scan import scan

    finder, took = NoticeFinder(), []
    for n in (4_000, 16_000):
        began = time.time()
        got = scan(finder, "all rights reserved and cc by " * n)
        took.append(time.time() - began)
        assert got[:4] == (6 * n, 2 * n, 0, 6 * n - 2)
    assert took[1] < 10 * took[0] + 0.5


def test_fuzzy_labels_against_every_place():
    """A notice with edits is found where, and only where, some stretch of the text is within the bound."""
    import numpy as np

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    phrase = "redistribution and use in source"
    finder, rng, seen = NoticeFinder({phrase: "bsd"}), np.random.default_rng(3), set()
    most = len(phrase) // 12
    for _ in range(150):
        text = list(phrase)
        for _ in range(int(rng.integers(0, 5))):
            at, what = int(rng.integers(0, len(text))), rng.integers(0, 3)
            text[at : at + (what != 1)] = [] if what == 0 else [str(rng.choice(list("abcz")))]
        line = words_line("before it " + "".join(text) + " after it")
        blanks = [i for i, c in enumerate(line) if c == 32]
        near = min(distance(line[a + 1 : b], phrase.encode()) for i, a in enumerate(blanks) for b in blanks[i + 1 :] if abs(b - a - 1 - len(phrase)) <= most) if len(blanks) > 1 else 99
        found = finder.find(line)
        assert bool(found) == (near <= most), line
        seen.add(bool(found))
    assert seen == {True, False}


def test_notices_from_a_table(spark):
    from siltstone.llm.license_scan import notice_table

    table = spark.createDataFrame([("Do What You Like, please!", "free"), (None, "x"), ("...", "none"), ("do what you like please", "also")], "notice string, label string")
    notices = notice_table(table)
    assert notices == {"do what you like please": "also"}
    docs = spark.createDataFrame([(1, "You may do what you lik please."), (2, "nothing")], "doc_id long, text string")
    assert [r.labels for r in license_scan(docs, notices).orderBy("doc_id").collect()] == ["also", ""]
    assert [r.labels for r in license_scan(docs, {}).orderBy("doc_id").collect()] == ["", ""]
