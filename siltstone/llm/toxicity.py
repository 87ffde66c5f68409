"""Toxic texts by logistic regression on hashed word n-grams and skip-grams, fitted with FTRL-proximal.

The fit goes over a bounded sample of labelled texts, one text after the other: each coordinate has a learning rate of its own,
which falls with the gradients that it has seen, and an L1 penalty keeps all but the coordinates that speak for or against
a label at zero. What is left is small and goes to all workers. A weight belongs to the full 64-bit hash of
an n-gram, not to its coordinate alone, so an n-gram that only shares the coordinate has no weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.common import ascii_lower, written

#: Coordinates of the fit.
BITS = 22
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words that are hashed at a time; a text of any length takes a bounded amount of memory.
_CHUNK = 100_000
#: Odd multipliers, one for each word of an n-gram and for each kind of it.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_KIND = {"2": np.uint64(0xD6E8FEB86659FD93), "3": np.uint64(0xA0761D6478BD642F), "1_1": np.uint64(0xE7037ED1A0B428DB), "1__1": np.uint64(0x8EBC6AF09C88C6E3)}


class _Words(dict):
    """Hashes of words, kept for those to come."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return found


def _mixed(kind: str, *parts: np.ndarray) -> np.ndarray:
    h = _KIND[kind] ^ (parts[0] * _MIX[0])
    for part, mix in zip(parts[1:], _MIX[1:], strict=False):
        h = (h ^ (h >> np.uint64(29))) * mix + part * mix
    return h ^ (h >> np.uint64(32))


def grams(text: str | None, memo: dict) -> Iterator[np.ndarray]:
    """Hashes of the words of a lower-cased text, of pairs and triples of neighbours, and of pairs with one or two words between.

    In arrays of bounded size; an n-gram may come up more than once.
    """
    held: list[int] = []
    tail = 0
    for m in _WORD.finditer(text or ""):
        held.append(memo[m.group()])
        if len(held) == _CHUNK:
            yield from _arrays(np.array(held, np.uint64), tail)
            held, tail = held[-3:], 3
    if len(held) > tail:
        yield from _arrays(np.array(held, np.uint64), tail)


def _arrays(h: np.ndarray, tail: int) -> Iterator[np.ndarray]:
    """N-grams that end after the first tail words, which were there before."""
    yield h[tail:]
    for kind, back in (("2", (1,)), ("1_1", (2,)), ("1__1", (3,)), ("3", (2, 1))):
        far = back[0]
        first = max(tail, far)
        if first < len(h):
            yield _mixed(kind, *(h[first - b : len(h) - b] for b in back), h[first:])


@dataclass
class Model:
    """Hashes (sorted) and their weights; bias is the log odds of a text without any of them."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def score(self, text: str | None, memo: dict) -> float:
        """The probability of label 1. Each n-gram of the text counts once."""
        found = []
        for h in grams(text, memo):
            h = h[self.near[(h & np.uint64(0xFFFF)).astype(np.int64)]]
            if len(h):
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                found.append(np.unique(at[self.keys[at] == h]))
        total = self.bias + (float(self.weights[np.unique(np.concatenate(found))].sum()) if found else 0.0)
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


class Ftrl:
    """FTRL-proximal over binary features. z, n: the sums of adjusted gradients and of squared ones for each coordinate."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: float) -> None:
        """One text: its coordinates (each once) and its label. Coordinate 0 is the bias, which has no penalty."""
        z, n, w = self.z[at], self.n[at], self.weights(at)
        w0 = self.bias()
        g = float(1 / (1 + np.exp(-np.clip(w0 + w.sum(), -40, 40)))) - label
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        n0 = self.n[0]
        self.z[0] += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / self.alpha * w0
        self.n[0] = n0 + g * g

    def bias(self) -> float:
        return float(-self.z[0] * self.alpha / (self.beta + np.sqrt(self.n[0])))


def coordinates(h: np.ndarray) -> np.ndarray:
    """1 to 2^BITS - 1; 0 is the bias."""
    return (h >> np.uint64(64 - BITS)).astype(np.int64).clip(1)


def held_out() -> Column:
    """Of the documents: crc32(doc_id as text) mod 3 is 1. False for a null id, which isn't trained on either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = 6000) -> DataFrame:
    """digest, text, label and rows (of that label in all) of the texts to learn from.

    Labels of rows that are held out aren't looked at. Labels of one id or text are settled by majority (an even split
    counts as 1); null labels and ids don't count. Of the distinct texts, at most per_label of each label are drawn, by
    a hash of the text, so copies don't matter.
    """
    said = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).select("doc_id", "toxic")
    digest = F.sha2(F.col("text"), 256)
    rows = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", digest.alias("digest"))
    texts = rows.join(said, "doc_id").groupBy("digest").agg(F.avg("toxic").alias("share"), F.min("doc_id").alias("doc_id"))
    texts = written(texts.select("digest", "doc_id", (F.col("share") >= 0.5).cast("int").alias("label")), "labelled")
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = None
    for label, n in sorted(sizes.items()):
        # A draw by the digest's first digits is a little over the bound; the rest goes by order.
        share = min(1.0, 1.2 * per_label / n + 100 / n)
        part = texts.where((F.col("label") == label) & (F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") < share * 2**32))
        part = part.orderBy("digest").limit(per_label).withColumn("rows", F.lit(n).cast("long"))
        drawn = part if drawn is None else drawn.unionByName(part)
    if drawn is None:
        drawn = texts.withColumn("rows", F.lit(0).cast("long"))
    # at most per_label rows of each of two labels: small enough for all workers
    found = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return found.where(F.sha2(F.col("text"), 256) == F.col("digest")).dropDuplicates(["digest"]).select("digest", "text", "label", "rows")


def _features(batches):
    memo = _Words()
    schema = pa.schema([("digest", pa.string()), ("label", pa.int32()), ("rows", pa.int64()), ("at", pa.binary()), ("n_at", pa.int64())])
    for b in batches:
        for k in range(b.num_rows):
            parts = [np.unique(coordinates(h)) for h in grams(b["text"][k].as_py(), memo)]
            at = np.unique(np.concatenate(parts)).astype("<i4") if parts else np.zeros(0, "<i4")
            columns = ([b["digest"][k].as_py()], [b["label"][k].as_py()], [b["rows"][k].as_py()], [at.tobytes()], [len(at)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _trainer(epochs: int, alpha: float, beta: float, l1: float, l2: float):
    def run(batches):
        rows, labels, totals = [], [], {}
        for b in batches:
            for at, label, n in zip(b["at"].to_pylist(), b["label"].to_pylist(), b["rows"].to_pylist(), strict=True):
                rows.append(np.frombuffer(at, "<i4"))
                labels.append(label)
                totals[label] = n
        model = Ftrl(1 << BITS, alpha, beta, l1, l2)
        for epoch in range(epochs if rows else 0):
            for k in np.random.default_rng(epoch).permutation(len(rows)):
                model.learn(rows[k], labels[k])
        kept = np.flatnonzero(np.abs(model.z) > model.l1)
        kept = kept[kept > 0]
        # What the draw did to the share of the labels, the bias makes good.
        taken = {y: max(1, labels.count(y)) for y in (0, 1)}
        shift = np.log(max(1, totals.get(1, 1)) / taken[1]) - np.log(max(1, totals.get(0, 1)) / taken[0])
        at, w = np.append(0, kept), np.append(model.bias() + shift if rows else -20.0, model.weights(kept))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["at", "weight"])

    return run


def _resolver(shared):
    """(hash, at, n): n-grams of the training texts whose coordinate has a weight; n counts a batch's texts that hold them."""

    def run(batches):
        memo = _Words()
        heavy = np.zeros(1 << BITS, bool)
        heavy[shared.value] = True
        for b in batches:
            found = []
            for k in range(b.num_rows):
                parts = [np.unique(h[heavy[coordinates(h)]]) for h in grams(b["text"][k].as_py(), memo)]
                if parts:
                    found.append(np.unique(np.concatenate(parts)))
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(coordinates(h)), pa.array(n.astype(np.int64))], ["hash", "at", "n"])

    return run


def fit(train: DataFrame, epochs: int = 10, alpha: float = 5.0, beta: float = 0.1, l1: float = 10.0, l2: float = 0.0, least: int = 3, features: int = 32_000_000) -> Model:
    """A model from the rows of training_rows.

    Their number is bounded there; the one task that learns from them also takes no more than features coordinates in
    all, by order of their digests, so its memory is bounded however long they are. Of the n-grams that share a
    coordinate, the one that most training texts hold gets its weight, if least texts do. Without rows, all scores are 0.
    """
    spark = train.sparkSession
    train = written(train.withColumn("text", ascii_lower(F.col("text"))), "toxic-sample")
    rows = written(train.mapInArrow(_features, "digest string, label int, rows long, at binary, n_at long"), "toxic-features")
    before = F.sum("n_at").over(Window.orderBy("digest"))  # a bounded number of rows
    kept = rows.select("digest", "n_at").withColumn("total", before).where(F.col("total") <= features).select("digest")
    rows = rows.join(F.broadcast(kept), "digest").repartition(1).sortWithinPartitions("digest")
    found = rows.select("at", "label", "rows").mapInArrow(_trainer(epochs, alpha, beta, l1, l2), "at long, weight double").collect()
    weight = {r["at"]: r["weight"] for r in found}
    bias = weight.pop(0, -20.0)
    if not weight:
        return Model(np.zeros(0, np.uint64), np.zeros(0), bias)
    shared = spark.sparkContext.broadcast(np.array(sorted(weight)))
    named = train.select("text").mapInArrow(_resolver(shared), "hash long, at long, n long").groupBy("at", "hash").agg(F.sum("n").alias("n"))
    named = named.where(F.col("n") >= least).groupBy("at").agg(F.max(F.struct("n", "hash")).alias("best")).select("at", "best.hash").collect()
    keys = np.array([r["hash"] for r in named], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Model(keys[order], np.array([weight[r["at"]] for r in named])[order], bias)


def _predictor(shared, threshold: float):
    def run(batches):
        memo, model = _Words(), shared.value
        for b in batches:
            low = b["_low"]
            scores = [model.score(low[k].as_py(), memo) for k in range(b.num_rows)]
            new = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*b.schema.names[:-1], "score", "predicted"])

    return run


def predict(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs without text, with score (0 to 1) and predicted (1 from threshold on). Only the text is looked at.

    Null and empty texts get the score of a text without known n-grams. Repeated rows get the same score; columns named score,
    predicted or _low are replaced; a text of any length counts whole; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted", "_low", "text")]
    rows = docs.select(*kept, ascii_lower(F.col("text")).alias("_low"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1]) + "score double, predicted int"
    return rows.mapInArrow(_predictor(shared, threshold), schema)
