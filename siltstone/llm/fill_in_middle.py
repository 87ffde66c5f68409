"""Texts for filling in the middle: prefix, suffix and middle in another order, each behind a sentinel.

One Aho-Corasick automaton goes over a text once. Its words are the sentinels and the few ASCII characters at which
the kind of unit changes, so a text is described by its events alone: between two of them, units follow each other at
even steps, and the place of any unit comes from a search in the list of events and a multiplication.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prefix, suffix and middle (fixed by the contract of the query).
SENTINELS = ("<P>", "<S>", "<M>")
#: The ASCII characters at which one unit ends and another kind begins. Code points have none: all of a text is one stretch.
CHANGES = {"chars": "", "words": " \t\n\x0b\x0c\r", "lines": "\n"}
_FLUSH = 8 << 20


class Events:
    """Stretches of a text: where each starts, and the number of its first unit; n: units in all; marks: (place, sentinel).

    A stretch of code points holds a unit for each of them. Other stretches are one unit: in words a run of blanks or a
    run of other characters, in lines everything up to a line feed.
    """

    def __init__(self, length: int, unit: str):
        self.unit, self.length, self.n = unit, length, 0
        self.at, self.rank, self.marks = [], [], []

    def stretch(self, start: int, end: int) -> None:
        if end > start:
            self.at.append(start)
            self.rank.append(self.n)
            self.n += end - start if self.unit == "chars" else 1

    def place(self, k: int) -> int:
        """Where unit k starts; for k = n, the end of the text."""
        if k >= self.n:
            return self.length
        j = bisect_right(self.rank, k) - 1
        return self.at[j] + (k - self.rank[j] if self.unit == "chars" else 0)


class Scanner:
    """The automaton for a kind of unit and three sentinels.

    Sentinels that could overlap each other or make one up with the text beside them are refused: what holds them
    couldn't be taken apart again.
    """

    def __init__(self, unit: str = "chars", sentinels: tuple[str, str, str] = SENTINELS):
        if unit not in CHANGES:
            raise ValueError(f"unit must be one of {', '.join(CHANGES)}")
        if len(set(sentinels)) < len(sentinels) or "" in sentinels:
            raise ValueError("sentinels must be different and not empty")
        for a, b in product(sentinels, repeat=2):
            if any(a.endswith(b[:k]) for k in range(1, len(b) + (a != b))) or (a != b and b in a):
                raise ValueError(f"sentinels {a!r} and {b!r} can overlap")
        self.unit, self.sentinels = unit, sentinels
        self.automaton = ahocorasick.Automaton()
        for c in CHANGES[unit]:
            self.automaton.add_word(c, (1, None))
        for s in sentinels:
            self.automaton.add_word(s, (len(s), s))
        self.automaton.make_automaton()

    def scan(self, text: str) -> Events:
        out, done, blank = Events(len(text), self.unit), 0, None
        for last, (size, sentinel) in self.automaton.iter(text):
            if sentinel is not None:
                out.marks.append((last + 1 - size, sentinel))
            elif self.unit == "lines":
                out.stretch(done, last + 1)
                done = last + 1
            else:
                if blank is not None and last > done:  # blanks ended before this one
                    out.stretch(blank, done)
                    blank = None
                if blank is None:
                    out.stretch(done, last)
                    blank = last
                done = last + 1
        if blank is not None:
            out.stretch(blank, done)
        out.stretch(done, len(text))
        return out


def _draws(doc_id: int | None, salt: str) -> list[int]:
    """Four 32-bit numbers of a document: a repeated id gets the same ones, a missing id those of no digits."""
    h = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]


def rearranged(scanner: Scanner, doc_id: int | None, text: str, salt: str = "1", plain: int = 10, spm: int = 20):
    """(units, form, prefix, middle, output): characters of prefix and middle are None for plain texts."""
    events = scanner.scan(text)
    h1, h2, h3, h4 = _draws(doc_id, salt)
    if not text or events.marks or h3 % 100 >= 100 - plain:
        return events.n, "plain", None, None, text
    first, second = sorted((h1 % (events.n + 1), h2 % (events.n + 1)))
    a, b = events.place(first), events.place(second)
    p, s, m = scanner.sentinels
    if h4 % 100 < spm:
        return events.n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return events.n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def rebuilt(scanner: Scanner, form: str, output: str) -> str:
    """The text that an output was made of, from the output and its form alone."""
    if form == "plain":
        return output
    p, s, m = scanner.sentinels
    order = (s, p, m) if form == "spm" else (p, s, m)
    marks = scanner.scan(output).marks
    if tuple(x for _, x in marks) != order or marks[0][0] != 0:
        raise ValueError(f"not an output of form {form}")
    ends = [at for at, _ in marks[1:]] + [len(output)]
    part = {x: output[at + len(x) : end] for (at, x), end in zip(marks, ends, strict=True)}
    return part[p] + part[m] + part[s]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size_of: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a bounded number of characters."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[size_of])
        if chars > _FLUSH or len(held) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)


_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_in_middle(docs: DataFrame, unit: str = "chars", sentinels: tuple[str, str, str] = SENTINELS, salt: str = "1", plain: int = 10, spm: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: a row for each row of docs.

    n counts units (chars: code points; words: runs of blanks and of other characters; lines). The two cuts are drawn
    by salt and doc_id; plain percent of the texts, empty ones and those that hold a sentinel stay as they are, spm
    percent of the others get the suffix first. A null text counts as empty, a null id draws like an id without
    digits; repeated rows get the same answer; columns other than doc_id and text are ignored; texts of any length
    are cut whole; an empty table gives no rows.
    """
    Scanner(unit, sentinels)  # refuses what it can't use before any task runs

    def run(batches):
        scanner = Scanner(unit, sentinels)

        def rows():
            for b in batches:
                for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                    doc_id = doc_id.as_py()
                    yield (doc_id, *rearranged(scanner, doc_id, text.as_py() or "", salt, plain, spm))

        return _batches(rows(), _OUT, 5)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def restore(outputs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The columns of outputs (form and output among them) but output itself, and restored: the text it was made of.

    A null output gives null. An output that doesn't hold the sentinels of its form, in order, is an error.
    """
    kept = [c for c in outputs.columns if c not in ("output", "restored")]
    rows_in = outputs.select(*kept, "output")

    def run(batches):
        scanner = Scanner("chars", sentinels)
        for b in batches:
            start = chars = 0
            texts: list[str | None] = []
            forms, made = b["form"], b["output"]
            for k in range(b.num_rows):
                output = made[k].as_py()
                texts.append(None if output is None else rebuilt(scanner, forms[k].as_py(), output))
                chars += len(texts[-1] or "")
                if chars > _FLUSH or k + 1 == b.num_rows:
                    part = b.slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*part.schema.names[:-1], "restored"])
                    start, chars, texts = k + 1, 0, []

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows_in.schema.fields[:-1]) + ", restored string"
    return rows_in.mapInArrow(run, schema)
