"""Stretches of words that repeat with a short period, found by refining classes of equal factors.

Crochemore's method: two places are in one class of level L if the same L words start there. From level to level
classes are split by the classes that the next words start; of what a class falls into, all parts but the largest serve to
split others, so a place is looked at a logarithmic number of times. Members of a class are linked by place. Two
neighbours that are L apart on level L are a square with a primitive root of L words, and squares that start at
consecutive places are one run.

Many documents are refined together, as one sequence whose documents share no class. A run of exponent e holds
each of its words and factors e - 1 times at least, so rarer ones are put in classes of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words (fixed by the contract of the query).
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Documents are refined together until they have so many words.
TOGETHER = 400_000

Run = tuple[int, int, int]


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    total = int(size.sum())
    out = np.ones(total, np.int64)
    if total:
        ends = np.cumsum(size)
        out[0] = first[0]
        out[ends[:-1]] = first[1:] - first[:-1] - size[:-1] + 1
    return np.cumsum(out)


class _Gaps:
    """Pairs of neighbours by their distance, until that level is reached; sorted once for each doubling of the level."""

    def __init__(self):
        self.later, self.bound, self.now = [], 1, {}

    def add(self, place: np.ndarray, gap: np.ndarray) -> None:
        far = gap >= self.bound
        if far.any():
            self.later.append((place[far], gap[far]))
            place, gap = place[~far], gap[~far]
        self._sorted(place, gap)

    def _sorted(self, place: np.ndarray, gap: np.ndarray) -> None:
        if len(gap):
            order = np.argsort(gap, kind="stable")
            place, gap = place[order], gap[order]
            cuts = np.flatnonzero(np.diff(gap)) + 1
            for a, part in zip(gap[np.concatenate(([0], cuts))].tolist(), np.split(place, cuts), strict=True):
                self.now.setdefault(a, []).append(part)

    def take(self, level: int, after: np.ndarray) -> np.ndarray:
        """The places whose neighbour is still level away."""
        if level >= self.bound:
            self.bound, later, self.later = 2 * level, self.later, []
            for place, gap in later:
                held = after[place] == place + gap
                self.add(place[held], gap[held])
        found = self.now.pop(level, None)
        if not found:
            return np.zeros(0, np.int64)
        place = np.concatenate(found)
        return np.unique(place[after[place] == place + level])


class _Classes:
    """The classes of one level: those of a class lie together in order, from first on; after and before link them by place."""

    def __init__(self, codes: np.ndarray, limit: np.ndarray, least: int):
        n = len(codes)
        self.least, self.limit = least, limit
        _, cls, size = np.unique(codes, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(size[cls] < least + 1)
        cls[rare] = len(size) + np.arange(len(rare))
        self.cls = cls
        self.size = np.bincount(cls, minlength=len(size) + len(rare))
        self.used = len(self.size)
        self.order = np.argsort(cls, kind="stable")
        self.loc = np.empty(n, np.int64)
        self.loc[self.order] = np.arange(n)
        self.first = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.after, self.before, self.going = np.full(n, -1), np.full(n, -1), np.zeros(n, bool)
        same = np.flatnonzero(cls[self.order[1:]] == cls[self.order[:-1]])
        a, b = self.order[same], self.order[same + 1]
        self.after[a], self.before[b] = b, a
        # All places whose word is frequent are grouped by the next word's class.
        self.splitters = np.flatnonzero(self.size[cls] > 1) + 1
        self.splitters = self.splitters[self.splitters < n]
        self.fresh = (a, b)

    def _room(self, n: int) -> None:
        if self.used + n > len(self.size):
            more = max(n, len(self.size))
            self.size = np.concatenate((self.size, np.zeros(more, np.int64)))
            self.first = np.concatenate((self.first, np.zeros(more, np.int64)))

    def refine(self, level: int) -> None:
        """From the classes of the level before to those of this one; fresh: the neighbours that are new."""
        self.fresh = (np.zeros(0, np.int64),) * 2
        p = self.splitters[self.limit[self.splitters - 1] >= level]
        q = p - 1
        active = self.size[self.cls[q]] > 1
        q = np.sort(q[active])
        self.splitters = np.zeros(0, np.int64)
        if not len(q):
            return
        old, by = self.cls[q], self.cls[q + 1]
        order = np.argsort(old * (self.used + 1) + by, kind="stable")
        q, old, by = q[order], old[order], by[order]
        start = np.flatnonzero(np.concatenate(([True], (old[1:] != old[:-1]) | (by[1:] != by[:-1]))))
        count = np.diff(np.append(start, len(q)))
        parent = old[start]
        # Where a whole class was looked at, its largest part stays; so something stays in each class.
        heads = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        moved = np.add.reduceat(count, heads)
        largest = np.maximum.reduceat(count, heads)
        whole = moved == self.size[parent[heads]]
        family = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(parent))))
        top = np.flatnonzero(count == largest[family])
        top = top[np.concatenate(([True], family[top][1:] != family[top][:-1]))]  # the first of the largest in each family
        goes = np.ones(len(count), bool)
        goes[top[whole]] = False
        if not goes.any():
            return
        picked = np.repeat(goes, count)
        q = q[picked]
        count, parent = count[goes], parent[goes]
        self._unlink(q, np.repeat(parent, count))
        self._move(q, count, parent)

    def _unlink(self, q: np.ndarray, old: np.ndarray) -> None:
        """Takes places out of the lists of their classes, and links those that are neighbours then."""
        r = q[np.lexsort((q, old))]
        prev, nxt = self.before[r], self.after[r]
        a = prev[np.concatenate(([True], prev[1:] != r[:-1]))]
        b = nxt[np.concatenate((nxt[:-1] != r[1:], [True]))]
        self.after[a[a >= 0]] = b[a >= 0]
        self.before[b[b >= 0]] = a[b >= 0]
        both = (a >= 0) & (b >= 0)
        self.fresh = (a[both], b[both])

    def _move(self, q: np.ndarray, count: np.ndarray, parent: np.ndarray) -> None:
        """Makes each group of q (count places each, out of class parent, by parent) a class, and picks what splits next."""
        heads = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        moved = np.add.reduceat(count, heads)
        owner = parent[heads]
        left = self.size[owner] - moved
        # The last moved places of each class's stretch become those of its new classes.
        begin = self.first[owner] + left
        slots = _spread(begin, moved)
        self.going[q] = True
        stays = self.order[slots]
        stays = stays[~self.going[stays]]
        self.going[q] = False
        outside = self.loc[q] < np.repeat(begin, moved)
        self.order[self.loc[q[outside]]] = stays
        self.loc[stays] = self.loc[q[outside]]
        self.order[slots] = q
        self.loc[q] = slots
        # Groups too small for a run become classes of one place.
        small = count < self.least
        unit = np.where(small, count, 1)
        sizes = np.repeat(np.where(small, 1, count), unit)
        self._room(len(sizes))
        ids = self.used + np.arange(len(sizes))
        self.used += len(sizes)
        ends = np.cumsum(sizes)
        self.size[ids], self.first[ids] = sizes, slots[ends - sizes]
        self.size[owner] = left
        self.cls[q] = np.repeat(ids, sizes)
        linked = np.ones(len(q), bool)
        linked[ends - 1] = False
        a = q[linked]
        b = q[np.flatnonzero(linked) + 1]
        self.before[q] = -1
        self.after[q] = -1
        self.after[a], self.before[b] = b, a
        self.fresh = (np.concatenate((self.fresh[0], a)), np.concatenate((self.fresh[1], b)))
        # All parts but the largest split other classes on the next level.
        family = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(parent))))
        largest = np.maximum.reduceat(count, heads)
        rest = left < largest
        top = np.flatnonzero((count == largest[family]) & rest[family] & ~small)
        top = top[np.concatenate(([True], family[top][1:] != family[top][:-1]))] if len(top) else top
        splits = np.ones(len(count), bool)
        splits[top] = False
        rest = np.zeros(len(heads), bool)
        rest[family[top]] = True
        out = [q[np.repeat(splits, count)]]
        if rest.any():
            out.append(self.order[_spread(self.first[owner[rest]], left[rest])])
        p = np.concatenate(out)
        self.splitters = p[p > 0]


def find_runs(docs: list[list[str]], least_length: int = 6, exponent: int = 4) -> list[list[Run]]:
    """For each document, its runs (start, length, period) by start, then period.

    A run has a smallest period of q words, max(least_length, exponent * q) words at least, and no neighbouring word
    that continues it. The exponent must be 3 or more.
    """
    if exponent < 3:
        raise ValueError("the exponent must be 3 or more")
    out: list[list[Run]] = [[] for _ in docs]
    ids: dict[str, int] = {}
    parts, starts, limits, at = [], [], [], 0
    for words in docs:
        parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
        starts.append(at)
        limits.append(len(words) // exponent)
        at += len(words) + 1
    n = at
    codes, owner, limit = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, (own, a) in enumerate(zip(parts, starts, strict=True)):
        b = a + len(own)
        codes[a:b], owner[a : b + 1], limit[a:b] = own, k, limits[k]
    # No class holds places of two documents, and the end of each is a class of its own.
    codes = codes + owner * (len(ids) + 1)
    if n == 0 or max(limits) == 0:
        return out
    classes, gaps = _Classes(codes, limit, exponent - 1), _Gaps()
    found = []
    for level in range(1, max(limits) + 1):
        if level > 1:
            if not len(classes.splitters):
                break
            classes.refine(level)
        a, b = classes.fresh
        gap = b - a
        near = (gap >= level) & (gap <= limit[a])
        gaps.add(a[near], gap[near])
        squares = gaps.take(level, classes.after)
        if len(squares):
            cut = np.flatnonzero(np.diff(squares) != 1)
            first = squares[np.concatenate(([0], cut + 1))]
            length = squares[np.append(cut, len(squares) - 1)] - first + 2 * level
            ok = length >= max(least_length, exponent * level)
            found += [(a, n, level) for a, n in zip(first[ok].tolist(), length[ok].tolist(), strict=True)]
    for a, length, period in sorted(found):
        k = int(owner[a])
        out[k].append((a - starts[k], length, period))
    return out


def greatest(runs: list[Run]) -> Run | None:
    """The run of the greatest length/period, compared exactly; of equals the first start, then the smallest period."""
    best = None
    for run in runs:
        if best is None or (c := run[1] * best[2] - best[1] * run[2]) > 0 or (c == 0 and (run[0], run[2]) < (best[0], best[2])):
            best = run
    return best


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop)[:-1].tolist(), strict=True) if not d]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("top", _RUN), ("collapsed", pa.string())])


def periodic_runs(docs: DataFrame, least_length: int = 6, exponent: int = 4, edit: Callable[[int | None, list[str]], list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), top, collapsed: a row for each row of docs.

    runs holds start, length and period in words, numbered from 0; top is the run of the greatest exponent, null where
    there is none; collapsed is the text's words without later periods of its runs, joined by one space. edit, where
    given, gets each id with its words and returns the words to look at. A null text has no words. Null ids and
    repeated rows are kept as they are; columns other than doc_id and text are ignored; texts of any length
    are refined whole; an empty table gives no rows.
    """

    def answers(ids: list, texts: list[list[str]]) -> pa.RecordBatch:
        every = find_runs(texts, least_length, exponent)
        struct = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in every]
        top = [None if (t := greatest(runs)) is None else dict(zip(("start", "length", "period"), t, strict=True)) for runs in every]
        short = [" ".join(collapsed(w, runs)) for w, runs in zip(texts, every, strict=True)]
        columns = (ids, [len(w) for w in texts], struct, top, short)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _OUT.types, strict=True)], schema=_OUT)

    def run(batches):
        ids, texts, total = [], [], 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                doc_id = doc_id.as_py()
                words = WORD.findall(text.as_py() or "")
                words = edit(doc_id, words) if edit else words
                ids.append(doc_id)
                texts.append(words)
                total += len(words) + 1
                if total >= TOGETHER:
                    yield answers(ids, texts)
                    ids, texts, total = [], [], 0
        if ids:
            yield answers(ids, texts)

    run_type = "struct<start:bigint,length:bigint,period:bigint>"
    schema = f"doc_id long, n_words long, runs array<{run_type}>, top {run_type}, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
