"""Lexical search over stems. Tokens are counted once for each document; each distinct word is stemmed once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.stems import stem, words
from siltstone.operators.retrieval import B, K1
from siltstone.shared import settled, small_batches


#: Counts that a task holds before it gives them out, but for those of one document.
ROWS = 1 << 14


def _counted(batches):
    for b in batches:
        ids, terms, n, lengths = [], [], [], []
        for k in range(b.num_rows):
            counts = Counter(words(b["text"][k].as_py()))
            ids += [k] * len(counts)
            terms += counts
            n += counts.values()
            lengths += [counts.total()] * len(counts)
            if len(ids) >= ROWS or (ids and k == b.num_rows - 1):
                yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(ids, pa.int64())), pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(lengths, pa.int64())], ["id", "word", "n", "length"])
                ids, terms, n, lengths = [], [], [], []


def word_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, word, n, length (of the document in words): plain words of each document, each word once. Null and wordless texts give no rows."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_counted, f"id {rows.schema['id'].dataType.simpleString()}, word string, n long, length long")


def stem_table(counts: DataFrame) -> DataFrame:
    """word, stem: each distinct word of word_counts() once, however many documents hold it."""

    def stems(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["word"], pa.array([stem(w) for w in b["word"].to_pylist()], pa.string())], ["word", "stem"])

    return counts.select("word").distinct().mapInArrow(stems, "word string, stem string")


def bm25_stems(docs: DataFrame, doc_id: str, text: str, question: Sequence[str], stems: DataFrame | None = None) -> DataFrame:
    """doc_id, score of each document that holds a word with the stem of one of the question's words.

    stems (word, stem) may be given; else it is made of the documents' words. Documents are read once, for their word counts; only words with
    a stem of the question go on from there. Words of a question that no document holds add nothing, repeated ones count once;
    null ids are left out.
    """
    counts = settled(word_counts(docs, doc_id, text).where("id IS NOT NULL"), "word-counts")
    table = stem_table(counts) if stems is None else stems
    wanted = sorted({stem(w) for q in question for w in words(q)})
    named = table.where(F.col("stem").isin(wanted)).select("word", "stem")
    hits = counts.join(named, "word").groupBy("id", "stem").agg(F.sum("n").alias("tf"), F.first("length").alias("length"))
    per_doc = counts.groupBy("id").agg(F.first("length").alias("length"))
    # documents without a word count, too: they are in the collection
    size = docs.where(F.col(doc_id).isNotNull()).agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(per_doc.agg(F.sum("length").alias("total")))  # one row each
    hits = settled(hits, "stem-hits")
    df = hits.groupBy("stem").agg(F.count(F.lit(1)).alias("df"))  # as many rows as the question has stems
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    avg = F.col("total") / F.col("n_docs")
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / avg))
    scored = hits.join(F.broadcast(df), "stem").join(F.broadcast(size)).groupBy("id").agg(F.sum(part).alias("score"))
    return scored.select(F.col("id").alias(doc_id), "score")
