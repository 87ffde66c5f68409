"""License notices: exact phrases by words, and short notices with a few edits."""

from __future__ import annotations

import functools

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and labels (fixed by the contract of the query).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices that are also found with edits (own choice of common wordings).
NOTICES = {
    "all rights reserved": "reserved",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the gnu general public license": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license version 2 0": "mpl",
}
#: A notice of n characters may have n // EDIT_EVERY insertions, deletions and substitutions in all.
EDIT_EVERY = 12

_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())]
)


def words_line(text: str | None) -> bytes:
    """The words, lower-cased (A-Z only), each between single blanks: UTF-8 with a blank at both ends."""
    words = (text or "").encode("utf-8", "replace").translate(_WORDS).split()
    return b" " + b" ".join(words) + b" " if words else b" "


class NoticeFinder:
    """Compiled notices. A notice with k edits allowed is cut into k + 1 seeds, one of which must stand unedited.

    One automaton finds the seeds of all notices in one pass over a text, however many notices there are.
    """

    def __init__(self, notices: dict[str, str] = NOTICES, edit_every: int = EDIT_EVERY):
        import regex

        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (phrase, label) in enumerate(notices.items()):
            body = phrase.encode()
            k = len(body) // edit_every
            fuzzy = regex.compile(rb"(?b) (?:" + regex.escape(body) + rb"){e<=%d}(?= )" % k)
            self.notices.append((len(body), k, label, fuzzy))
            cuts = [round(i * len(body) / (k + 1)) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(body[a:b].decode("latin-1"), []).append((n, b))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, uses)
        if seeds:
            self.automaton.make_automaton()

    def find(self, line: bytes) -> list[tuple[str, int, int, int, int]]:
        """(label, first byte, end byte, edits, notice length) of each notice in the line; overlapping ones once, the best."""
        places: dict[int, set[int]] = {}
        for last, uses in self.automaton.iter(line.decode("latin-1")) if self.notices else ():
            for n, b in uses:
                places.setdefault(n, set()).add(last + 1 - b)
        out = []
        for n, starts in places.items():
            size, k, label, fuzzy = self.notices[n]
            found: dict[tuple[int, int], int] = {}
            for s in sorted(starts):
                low = max(0, s - k - 1)
                m = fuzzy.search(line[low : s + size + k + 1])
                if m:
                    found[low + m.start() + 1, low + m.end()] = sum(m.fuzzy_counts)
            end = -1
            for (a, b), edits in sorted(found.items(), key=lambda x: (x[0][0], x[1])):
                if a >= end:
                    out.append((label, a, b, edits, size))
                    end = b
        return out


def scan(finder: NoticeFinder, text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    line = words_line(text)
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    base: list[tuple[int, str]] = []
    for phrase, label in BASE.items():
        needle = b" " + phrase.encode() + b" "
        at = line.find(needle)
        while at >= 0:
            base.append((int(np.searchsorted(blanks, at)), label))
            at = line.find(needle, at + 1)
    fuzzy = finder.find(line)
    starts = [w for w, _ in base]
    labels = {x for _, x in base}
    score = max([1.0 * bool(base), *(1 - edits / size for _, _, _, edits, size in fuzzy)])
    spans = [(int(np.searchsorted(blanks, a)) - 1, int(np.searchsorted(blanks, b)), label, edits) for label, a, b, edits, _ in fuzzy]
    return (
        max(0, line.count(b" ") - 1), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in fuzzy})), score,
        ",".join(f"{label}:{a}:{b}:{e}" for a, b, label, e in sorted(spans)),
    )


def _scanner(notices, edit_every):
    def run(batches):
        finder = _finder(notices, edit_every)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                rows = [(d, *scan(finder, t)) for d, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types, strict=True)], schema=_OUT)

    return run


@functools.lru_cache(maxsize=2)
def _finder(notices: tuple[tuple[str, str], ...], edit_every: int) -> NoticeFinder:
    """One per worker process, for all its tasks."""
    return NoticeFinder(dict(notices), edit_every)


def notice_table(table: DataFrame, most_bytes: int = 16 << 20) -> dict[str, str]:
    """Notices from a table (notice, label): their words, lower-cased (A-Z). Null or wordless ones are left out; of repeated ones the
    least label counts. They go to every worker, so more than most_bytes of them are an error."""
    rows = table.where(F.col("notice").isNotNull() & F.col("label").isNotNull()).groupBy("notice").agg(F.min("label").alias("label"))
    if (rows.agg(F.sum(F.octet_length("notice"))).first()[0] or 0) > most_bytes:
        raise ValueError(f"more than {most_bytes} bytes of notices")
    found = sorted((words_line(r["notice"]).strip().decode(), r["label"]) for r in rows.toLocalIterator())
    return {notice: label for notice, label in reversed(found) if notice}


def license_scan(docs: DataFrame, notices: dict[str, str] = NOTICES, edit_every: int = EDIT_EVERY) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans: a row for each row of docs.

    n_base and the words count exact base phrases; labels adds those of the edited notices. score is 1 less the
    share of edited characters of the best find, 0 without one. spans lists label:first word:end word:edits of the
    notices (phrase -> label, see notice_table; a phrase of n characters may have n // edit_every edits). Null and empty texts have no words, no finds, and null first and last words. Repeated rows and
    null ids are kept as they are; other columns are ignored; long texts are searched whole.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanner(tuple(notices.items()), edit_every), schema)
