"""Language by the nearest centroid: TF-IDF vectors of character n-grams, several centroids for each language."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import give_back, only, small_batches

#: Hashed features of a vector, as bits.
BITS = 12
_SIZE = 1 << BITS
#: Characters from which on a text must come up to the whole floor of its centroid.
FULL = 1000
_LETTER = re.compile(r"[A-Za-z]")
_CHUNK = 1 << 20


def _counts(text: str, into: np.ndarray) -> None:
    """Adds the text's letter n-grams (1 to 3 characters, lower-cased, runs of others as a blank) to into."""
    for i in range(0, len(text), _CHUNK):
        # chunks overlap by two characters, so each n-gram that ends in a chunk is counted there
        part = text[max(0, i - 2) : i + _CHUNK].lower()
        c = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
        c = np.where((c >= 0x80) | (c - 97 < 26), c, np.uint32(32)).astype(np.uint32)
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])] if len(c) else c
        one = c * np.uint32(0x9E3779B1)
        two = one[:-1] * np.uint32(31) + one[1:]
        three = two[:-1] * np.uint32(31) + one[2:]
        for grams in (one[2:] if i else one, two[1:] if i else two, three):
            mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            into += np.bincount(mixed >> np.uint32(32 - BITS), minlength=_SIZE)


def features(text: str, idf: np.ndarray) -> np.ndarray:
    """The text's TF-IDF vector of length 1 (0 for a text without n-grams)."""
    counts = np.zeros(_SIZE)
    _counts(text, counts)
    v = np.log1p(counts) * idf
    norm = np.linalg.norm(v)
    return (v / norm if norm else v).astype(np.float32)


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text))


@dataclass
class Model:
    """langs: of each centroid; floor: the least cosine that it accepts."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floor: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine with the nearest centroid (0 to 1), rejected. Without a letter: und, 0, rejected."""
        if text is None or not has_letter(text) or not self.langs:
            return "und", 0.0, True
        near = self.centroids @ features(text, self.idf)
        k = int(near.argmax())
        # A short text has few n-grams and is far from any centroid; its floor is lower, by the root of its length.
        floor = self.floor[k] * min(1.0, len(text) / FULL) ** 0.5
        return self.langs[k], float(min(1.0, max(0.0, near[k]))), bool(near[k] < floor)


def _frequencies(batches):
    only("languages")
    df, n = np.zeros(_SIZE, np.int64), 0
    for b in batches:
        for text in b["text"].to_pylist():
            counts = np.zeros(_SIZE)
            _counts(text, counts)
            df += counts > 0
            n += 1
    f = np.append(np.flatnonzero(df), -1)
    yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(np.append(df[f[:-1]], n), pa.int64())], ["feature", "n"])
    give_back()


def _clusters(k: int, idf: np.ndarray, slack: float):
    """Spherical k-means from seeds that lie far apart; a cluster's floor is its farthest member's cosine, times slack."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values(["key", "text"])["text"]
        x = np.stack([features(t, idf) for t in texts])
        chosen = [int((x @ x.mean(0)).argmax())]
        while len(chosen) < min(k, len(x)):
            chosen.append(int((x @ x[chosen].T).max(1).argmin()))
        c = x[chosen]
        for _ in range(20):
            own = (x @ c.T).argmax(1)
            new = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
            if np.allclose(new, c):
                break
            c = new
        near = x @ c.T
        own = near.argmax(1)
        low = [float(near[own == j, j].min()) * slack if (own == j).any() else 1.0 for j in range(len(c))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "k": range(len(c)), "vector": [v.tobytes() for v in c.astype("<f4")], "floor": low})

    return run


def fit(train: DataFrame, per_lang: int = 400, clusters: int = 4, slack: float = 0.5, max_langs: int = 1000) -> Model:
    """A model from train (text, lang, both non-null).

    Document frequencies are taken over all rows of train. The centroids are fitted on a sample bounded by
    per_lang distinct texts for each language, drawn by a hash of the text: how many copies a text has doesn't
    matter. More than max_langs languages are an error, so the model, which goes to the driver and to all workers,
    has a bounded size.
    """
    spark = train.sparkSession
    small_batches(spark)
    texts = train.select("lang", F.xxhash64("text", F.lit(3)).alias("a"), F.xxhash64("text", F.lit(5)).alias("b")).distinct()
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(max_langs + 1).collect()
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    df = train.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = {r["feature"]: r["n"] for r in df}
    n = found.pop(-1, 0)
    idf = np.zeros(_SIZE)
    if found:
        idf[list(found)] = np.log((1 + n) / (1 + np.array(list(found.values())))) + 1
    if not sizes:
        return Model(idf, np.zeros((0, _SIZE), np.float32), [], np.zeros(0))
    share = spark.createDataFrame([(r["lang"], 1.5 * per_lang / r["n"]) for r in sizes], "lang string, share double")
    key = F.xxhash64("text", F.lit(17))
    drawn = train.select("lang", "text").join(F.broadcast(share), "lang").withColumn("key", key)
    drawn = drawn.where(F.pmod("key", F.lit(1 << 30)) < F.col("share") * (1 << 30)).drop("share").dropDuplicates(["lang", "text"])
    first = Window.partitionBy("lang").orderBy("key", "text")
    drawn = drawn.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_lang).drop("rank")
    rows = drawn.groupBy("lang").applyInPandas(_clusters(clusters, idf, slack), "lang string, k int, vector binary, floor double")
    found = sorted(rows.collect(), key=lambda r: (r["lang"], r["k"]))
    vectors = [np.frombuffer(r["vector"], "<f4") for r in found]
    return Model(idf, np.stack(vectors) if vectors else np.zeros((0, _SIZE), np.float32), [r["lang"] for r in found], np.array([r["floor"] for r in found]))


def _predictor(model):
    def run(batches):
        only("languages")
        own = model.value
        for b in batches:
            said = [own.predict(t) for t in b["text"].to_pylist()]
            lang, score, rejected = zip(*said, strict=True) if said else ((), (), ())
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "lang_pred", "score", "rejected"])
        give_back()

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected. Only the text is looked at; columns of these names are replaced.

    A null text, or one without a letter, gets und, 0 and rejected; a text whose nearest centroid is farther than
    that centroid's farthest training text (with slack) is rejected but keeps its nearest language. Long texts
    count whole; repeated rows get the same answer; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    base = docs.select(*rest)
    if text_col != "text":
        base = base.withColumn("text", F.col(text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", lang_pred string, score double, rejected boolean"
    return base.mapInArrow(_predictor(shared), schema)


def held_out() -> Column:
    """Of the documents: crc32(doc_id as text) mod 4 is 2. False for a null id, which isn't trained on either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """text and lang of the rows to learn from: not held out, none of id, text and lang null. Repeated rows are all there; fit() takes each text once."""
    return docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang")
