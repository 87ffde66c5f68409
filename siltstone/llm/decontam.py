"""Benchmark passages in training documents, by an FM-index for each shard of documents.

A shard's texts are rows of word numbers. The index holds the Burrows-Wheeler transform of them in a wavelet
matrix, whose ranks answer "how many c in the first i places"; backward search takes a window's words from last
to first and keeps the range of suffixes that start with what it has read. The text places of a range come from
suffix positions that are sampled along the text: a step of the transform leads one word to the left, until a
sampled one. The places' words are marked and neighbouring ones merged into spans.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from siltstone.llm.common import give_back, join_hot, only, small_batches, written

_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


class WaveletMatrix:
    """Ranks in a row of numbers, by one row of bits for each binary digit."""

    def __init__(self, row: np.ndarray, bits: int):
        self.bits = bits
        self.ones, self.zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (row >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(row) - int(self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands in the first i places, for arrays of both."""
        start = np.zeros_like(i)
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            one = ((c >> b) & 1).astype(bool)
            i1, s1 = self.ones[k][i], self.ones[k][start]
            i, start = np.where(one, self.zeros[k] + i1, i - i1), np.where(one, self.zeros[k] + s1, start - s1)
        return i - start


def suffix_order(row: np.ndarray, is_end: np.ndarray) -> np.ndarray:
    """Positions of row by the suffixes that start there. Each end mark is a symbol of its own, in text order, before all words."""
    n = len(row)
    ends = np.cumsum(is_end)
    rank = np.where(is_end, ends - 1, row.astype(np.int64) + ends[-1])
    order = np.argsort(rank, kind="stable")
    key = rank[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)  # places of order that still share a rank
        if not len(at):
            return order
        own = order[at]
        after = rank[np.minimum(own + step, n - 1)]
        again = np.lexsort((after, rank[own]))
        own, after, first = own[again], after[again], rank[own[again]]
        order[at] = own
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (after[1:] != after[:-1])])
        head[at] = new
        rank[own] = np.maximum.accumulate(np.where(new, at, 0))
        step *= 2


class FMIndex:
    """Backward search and places over runs of word numbers (from 1); every run ends in an end mark (0)."""

    def __init__(self, row: np.ndarray, sample: int = 8):
        is_end = row == 0
        order = suffix_order(row, is_end)
        self.n, self.bits = len(row), max(1, int(row.max()).bit_length())
        self.bwt = row[order - 1]
        self.matrix = WaveletMatrix(self.bwt, self.bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=1 << self.bits))])
        run_start = np.concatenate([[0], np.flatnonzero(is_end)[:-1] + 1])
        inside = np.arange(self.n) - np.repeat(run_start, np.diff(np.append(run_start, self.n)))
        # every run's first word is sampled, so a walk to the left never crosses an end mark
        self.sampled = (inside % sample == 0)[order]
        self.place = np.where(self.sampled, order, -1)

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end suffix of those that start with each pattern (rows of word numbers, filled up with 0)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1]):
            live = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, lengths[live] - 1 - k].astype(np.int64)
            known = c < 1 << self.bits
            base = self.before[np.where(known, c, 0)]
            lo[live] = np.where(known, base + self.matrix.rank(c, lo[live]), 0)
            hi[live] = np.where(known, base + self.matrix.rank(c, hi[live]), 0)
        return lo, hi

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        """Text places of suffixes."""
        at, out, steps = suffixes.astype(np.int64), np.full(len(suffixes), -1, np.int64), 0
        left = np.arange(len(at))
        while len(left):
            hit = self.sampled[at[left]]
            out[left[hit]] = self.place[at[left[hit]]] + steps
            left = left[~hit]
            c = self.bwt[at[left]].astype(np.int64)
            at[left] = self.before[c] + self.matrix.rank(c, at[left])
            steps += 1
        return out


class Windows:
    """The windows of a block of benchmark items: each `size` words in a row, or a shorter item whole."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, own in items:
            n = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own]
            for i in range(max(1, len(n) - size + 1) if n else 0):
                found.setdefault(tuple(n[i : i + size]), set()).add(item)
        self.items = list(found.values())
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.patterns = np.zeros((len(found), size), np.int32)
        for i, w in enumerate(found):
            self.patterns[i, : len(w)] = w
        self.shortest = int(self.lengths.min()) if found else 0

    def numbers(self, text: str | None) -> np.ndarray:
        """A text's words by their numbers here; 0 for words that no window has."""
        own, look = words(text), self.vocabulary.get
        return np.fromiter((look(w, 0) for w in own), np.int32, len(own))


def hits(windows: Windows, texts: list[np.ndarray]) -> dict[int, tuple[np.ndarray, set[str]]]:
    """For each text with hits: which of its words are hit, and the items that do it.

    Words outside the windows can't be part of an occurrence, nor can a run of fewer words than the shortest
    window has; the index leaves them out.
    """
    if not windows.shortest:
        return {}
    sizes = np.array([len(t) for t in texts], np.int64)
    row = np.concatenate([np.zeros(0, np.int32), *texts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    known = np.concatenate([[False], row > 0, [False]])
    edge = known[1:] != known[:-1]
    edge[starts] |= known[starts] | known[np.minimum(starts + 1, len(known) - 1)]
    cuts = np.flatnonzero(edge)  # a run never reaches over two texts
    a, b = cuts[:-1], cuts[1:]
    long = (b - a >= windows.shortest) & known[a + 1]
    a, b = a[long], b[long]
    if not len(a):
        return {}
    lengths = b - a
    total = int((lengths + 1).sum())
    first = np.cumsum(lengths + 1) - lengths - 1
    short = np.zeros(total, np.int32)
    origin = np.full(total, -1, np.int64)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    to, of = np.repeat(first, lengths) + within, np.repeat(a, lengths) + within
    short[to], origin[to] = row[of], of
    index = FMIndex(short)
    lo, hi = index.ranges(windows.patterns, windows.lengths)
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    if not len(which):
        return {}
    suffix = np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    at = origin[index.locate(suffix)]
    mark = np.zeros(len(row) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + windows.lengths[which], -1)
    hit = np.cumsum(mark[:-1]) > 0
    text_of = np.searchsorted(starts, at, side="right") - 1
    out: dict[int, tuple[np.ndarray, set[str]]] = {}
    for t, w in zip(text_of.tolist(), which.tolist(), strict=True):
        if t not in out:
            out[t] = (hit[starts[t] : starts[t + 1]], set())
        out[t][1].update(windows.items[w])
    return out


def merged_spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and end word of each stretch of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


#: Bytes of text that one shard's index takes in, at most (a single longer text is a shard of its own).
SHARD_BYTES = 3 << 20

_FOUND = "n_words long, word_spans array<struct<first:long,end:long>>, items array<string>"


def _searcher(shared, id_type):
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def done(windows, ids, texts):
        found = hits(windows, texts)
        spans = [[{"first": x, "end": y} for x, y in merged_spans(found[i][0])] if i in found else [] for i in range(len(ids))]
        items = [sorted(found[i][1]) if i in found else [] for i in range(len(ids))]
        columns = [pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_spans", "items"])

    def run(batches):
        only("windows")
        windows, ids, texts, size = shared.value, [], [], 0
        for b in batches:
            for i in range(b.num_rows):
                text = b["text"][i].as_py()
                if ids and size + len(text or "") > SHARD_BYTES:
                    yield done(windows, ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(b["doc_id"][i].as_py())
                texts.append(windows.numbers(text))
                size += len(text or "")
        if ids:
            yield done(windows, ids, texts)
        ids, texts = [], []
        give_back()

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_words, word_spans (merged stretches of hit words), items (ids, sorted as strings) of each row of docs.

    The benchmark is the stated query set. It is dealt by item into blocks of about block_bytes of text at most;
    each block in turn goes to all workers and is searched in all documents. With several blocks distinct texts are
    written once, searched by each, and the finds put together by a digest of the text. Null texts have no words; null item ids are left out; repeated items count
    once, repeated rows of docs are all returned; only doc_id, item_id and text are looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    named = isinstance(docs.schema["doc_id"].dataType, StructType)  # other names of rows than numbers stay as they are
    rows = docs.select(F.col("doc_id") if named else F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = rows.schema["doc_id"].dataType
    texts = written(rows.select(_digest().alias("doc_id"), "text").dropDuplicates(["doc_id"]), "distinct-texts") if blocks > 1 else None
    parts = []
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        windows = Windows([(r["item_id"], words(r["text"])) for r in own.toLocalIterator()], size)
        shared = spark.sparkContext.broadcast(windows)
        if blocks == 1:
            return rows.mapInArrow(_searcher(shared, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, " + _FOUND)
        found = texts.mapInArrow(_searcher(shared, pa.string()), "doc_id string, " + _FOUND)
        parts.append(written(found.where(F.size("items") > 0), "contamination"))
    return _joined(rows, parts)


def _digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _joined(rows: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """The finds of several blocks, put together for each text."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # adjoining or overlapping spans of different blocks become one
    fold = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("word_spans"))),
        F.array().cast("array<struct<first:long,end:long>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["first"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    by_text = every.groupBy(F.col("doc_id").alias("key")).agg(fold.alias("word_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)).cast("long")
    keyed = written(rows.select("doc_id", _digest().alias("key"), n_words.alias("n_words")), "contamination-rows")
    sized = by_text.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")), "key")
    sized = written(sized, "contamination-texts")
    found = join_hot(keyed, sized, ["key"], "n_rows", keyed.count()).drop("n_rows")
    none = keyed.join(sized.select("key"), "key", "left_anti").withColumns(
        {"word_spans": F.array().cast("array<struct<first:long,end:long>>"), "items": F.array().cast("array<string>")}
    )
    return found.unionByName(none).drop("key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, word_spans: a row for each row of docs.

    A document is contaminated if any word is hit and share * n_hit >= n_words. See find_contamination().
    """
    n_hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    return find_contamination(docs, benchmark, size).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        "word_spans",
    )


def brute_force(texts: list[str | None], items: list[tuple[str, str | None]], size: int = 13) -> list[tuple[int, list[bool], list[str]]]:
    """(n_words, hit, items) of each text, by comparing every place: for tests."""
    windows: dict[tuple, set[str]] = {}
    low = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    for item, text in items:
        w = _WORD.findall((text or "").translate(low))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for text in texts:
        w = _WORD.findall((text or "").translate(low))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit[i : i + n] = [True] * n
                    found |= own
        out.append((len(w), hit, sorted(found)))
    return out
