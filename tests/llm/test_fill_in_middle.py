import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import fill_in_middle as fim
from siltstone.llm.queries import op13_fill_in_middle
from tests.llm.cases import ODD, clashing, empty, frame, rows_of, sample


def plainly(doc_id, text):
    """The contract, letter by letter."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_agrees_with_the_contract(spark):
    odd = [*ODD, (11, "holds <S> itself"), (12, "<P"), (13, "<<P<S"), (14, "P><S"), (15, "😀" * 700 + "<M")]
    got = rows_of(fim.fill_in_middle(frame(spark, odd)), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    want = sorted(((d, *plainly(d, t)) for d, t in odd), key=lambda r: [(x is not None, x) for x in r])
    assert got == want


def test_query_and_round_trip(spark):
    docs = {r.doc_id: r.text or "" for r in sample(spark, "0.01").collect()}
    forms = set()
    for r in op13_fill_in_middle(spark, "/root/testdata/sf0.01").collect():
        n, form, a, m, output = plainly(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, a, m)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_places_of_units_by_events():
    random.seed(3)
    for _ in range(300):
        text = "".join(random.choice("ab \n\t😀é") for _ in range(random.randrange(30)))
        words, last = [], None
        for i, c in enumerate(text):
            if last is None or (c in " \n\t") != last:
                words.append(i)
                last = c in " \n\t"
        lines = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]
        lines = [i for i in lines if i < len(text)]
        for unit, want in (("chars", list(range(len(text)))), ("words", words), ("lines", lines)):
            events = fim.Scanner(unit).scan(text)
            assert events.n == len(want)
            assert [events.place(k) for k in range(events.n + 1)] == [*want, len(text)]
    assert len(fim.Scanner("chars").scan("x" * 100_000).at) == 1  # without events, one stretch


@pytest.mark.parametrize("unit", ["chars", "words", "lines"])
def test_units_round_trip(spark, unit):
    docs = clashing(spark)
    made = fim.fill_in_middle(docs, unit=unit, sentinels=("[p]", "[s]", "[m]"), plain=0)
    back = fim.restore(made, sentinels=("[p]", "[s]", "[m]"))
    assert rows_of(back, "doc_id", "restored") == rows_of(docs.select("doc_id", F.coalesce("text", F.lit(""))))


def test_empty_table_and_nulls(spark):
    assert fim.fill_in_middle(empty(spark)).count() == 0
    some = spark.createDataFrame([("psm", None, 7)], "form string, output string, restored int")
    assert fim.restore(some).collect()[0].restored is None


def test_refuses_what_cannot_be_taken_apart():
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "P>x", "<M>"), ("aba", "<S>", "<M>"), ("", "<S>", "<M>"), ("a<S>b", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Scanner("chars", bad)
    scanner = fim.Scanner()
    for form, output in (("psm", "<P>a<M>b<S>c"), ("spm", "<P>a<S>b<M>c"), ("psm", "x<P>a<S>b<M>c"), ("psm", "<P>a<S>b")):
        with pytest.raises(ValueError):
            fim.rebuilt(scanner, form, output)
    with pytest.raises(ValueError):
        fim.Scanner("bytes")
