"""Notes and the questions put to them: anchors of a question, decay by group and kind, sentences, chunks by heading, mentions, health of the graph."""

from __future__ import annotations

import calendar
from collections.abc import Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.operators.retrieval import LADDER, bm25, cosine, ladder_decay
from siltstone.operators.timeseries import latest_n

#: Kinds of notes by the words that ask for them (fixed values).
KIND_WORDS = {
    "book": ("book", "book_chapter"), "books": ("book", "book_chapter"), "chapter": ("book_chapter",), "newsletter": ("newsletter",), "newsletters": ("newsletter",),
    "video": ("video",), "videos": ("video",), "transcript": ("video",), "transcripts": ("video",), "note": ("note",), "notes": ("note",), "topic": ("topic",), "topics": ("topic",),
    "filing": ("filing",), "filings": ("filing",), "earnings": ("filing",), "earning": ("filing",), "10-q": ("filing",), "10-k": ("filing",), "8-k": ("filing",),
    "research": ("research_answer",), "snapshot": ("smart_money_snapshot",), "snapshots": ("smart_money_snapshot",), "tier-1": ("smart_money_snapshot",), "tier-2": ("smart_money_snapshot",),
    "screenshot": ("tradingview-screenshot",), "screenshots": ("tradingview-screenshot",),
}
#: Days back that a phrase means, the first one found counts (fixed values).
PHRASE_DAYS = {
    "this quarter": 90, "last quarter": 180, "this month": 30, "last month": 60, "this week": 7, "last week": 14, "recent": 30, "recently": 30, "lately": 30,
    "today": 1, "yesterday": 2, "this year": 365, "last year": 730,
}
#: Words before a full stop that ends no sentence (fixed values).
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "st", "jr", "sr", "vs", "etc", "e.g", "i.e", "u.s", "u.k", "fig", "no", "vol", "approx", "inc", "ltd", "co", "corp", "p.s")

_MONTHS = {name.lower(): m for names in (calendar.month_name, calendar.month_abbr) for m, name in enumerate(names) if m} | {"sept": 9}
_MONTH = rf"(?i)\b({'|'.join(sorted(_MONTHS, key=len, reverse=True))})\s+(\d{{4}})\b"


def _quoted(word: str) -> str:
    return rf"(?i)\b{word.replace('.', '[.]')}\b"


def anchors(text: Column, lexicon: Sequence[str], today: Column) -> Column:
    """What a question asks for: tickers (capitals in the lexicon, in order), kinds, since (null without a time) and its other words.

    since is the earlier of the day that a phrase means and the first of a named month; a year alone counts if there is neither.
    """
    own = F.trim(F.coalesce(text, F.lit("")))
    tickers = F.array_distinct(F.filter(F.regexp_extract_all(own, F.lit(r"\b([A-Z]{1,5})\b"), 1), lambda t: t.isin(*lexicon))) if lexicon else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    kinds = F.array_distinct(F.flatten(F.array(*[F.when(own.rlike(_quoted(w)), F.array(*[F.lit(k) for k in ks])).otherwise(none) for w, ks in KIND_WORDS.items()])))
    back = F.coalesce(*[F.when(own.rlike(_quoted(p)), F.lit(d)) for p, d in PHRASE_DAYS.items()])
    number = F.element_at(F.create_map(*[F.lit(x) for pair in _MONTHS.items() for x in pair]), F.lower(F.regexp_extract(own, _MONTH, 1)))
    month = F.make_date(F.nullif(F.regexp_extract(own, _MONTH, 2).try_cast("int"), F.lit(0)), number, F.lit(1))
    said = F.least(F.date_sub(today, back), month)
    year = F.make_date(F.regexp_extract(own, r"\b(20\d{2})\b", 1).try_cast("int"), F.lit(1), F.lit(1))
    words = "|".join(sorted(map(str, (*KIND_WORDS, *PHRASE_DAYS)), key=len, reverse=True))
    rest = F.regexp_replace(F.regexp_replace(own, rf"(?i)\b({words})\b", " "), _MONTH, " ")
    rest = F.when(said.isNull(), F.regexp_replace(rest, r"\b20\d{2}\b", " ")).otherwise(rest)
    left = F.filter(F.array_except(F.split(rest, r"\s+"), tickers), lambda w: w != "")
    return F.struct(tickers.alias("tickers"), kinds.alias("kinds"), F.coalesce(said, year).alias("since"), left.alias("words"))


def anchored(asked: Column, path: Column, kind: Column, published: Column) -> Column:
    """Whether a note answers to the anchors: a folder or file name of one of the tickers, one of the kinds, and no older than since; undated notes are never too old."""
    low = F.lower(path)
    by_ticker = F.exists(asked["tickers"], lambda t: low.startswith(F.concat(F.lit("filings/"), F.lower(t), F.lit("/"))) | (low.startswith("research/") & low.contains(F.concat(F.lit("-"), F.lower(t), F.lit("-")))))
    by_kind = F.coalesce(F.array_contains(asked["kinds"], kind), F.lit(False))
    fresh = asked["since"].isNull() | published.isNull() | (published >= asked["since"])
    return ((F.size(asked["tickers"]) == 0) | F.coalesce(by_ticker, F.lit(False))) & ((F.size(asked["kinds"]) == 0) | by_kind) & fresh


def lexical(docs: DataFrame, key: str, fields: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """key, score, lexical_score of notes by the terms in all of the fields together; lexical_score is 1 / (1 + score)."""
    both = docs.select(key, F.concat_ws(" ", *fields).alias("_all"))
    return bm25(both, key, "_all", terms).withColumn("lexical_score", 1 / (1 + F.abs("score")))


def decayed(df: DataFrame, group: str, newest: Sequence[Column], kind: str, evergreen: Column, floor: float, overrides: Mapping[str, tuple[Sequence[float], float]]) -> DataFrame:
    """df with place and weight: the ladder's step for the place in its group, `floor` beyond it; a kind may have a ladder and floor of its own.

    Evergreen and ungrouped rows weigh 1; rows whose weight is 0 are dropped.
    """

    def step(ladder: Sequence[float], beyond: float) -> Column:
        return F.when(F.col("place") < len(ladder), F.get(F.array(*[F.lit(float(x)) for x in ladder]), F.col("place"))).otherwise(F.lit(float(beyond)))

    weight = F.when(F.coalesce(evergreen, F.lit(False)) | F.col(group).isNull(), 1.0)
    for name, (ladder, beyond) in overrides.items():
        weight = weight.when(F.col(kind) == name, step(ladder, beyond))
    return ladder_decay(df, group, newest).withColumn("weight", weight.otherwise(step(LADDER, floor))).where(F.col("weight") > 0)


def best_per(rows: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The row with the greatest score for each key, and of equal ones that with the greatest tie."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(score, tie)).alias("_best")).select(key, "_best.*")


def sentences(text: Column) -> Column:
    """The sentences of a text: it is cut at blanks after . ! or ? and before a capital, a digit or $, but not after an abbreviation.

    Blanks become one; detached punctuation at an end goes, and so do pieces of under three characters.
    """
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    short = "|".join(a.replace(".", "[.]") for a in ABBREVIATIONS)
    parts = F.split(body, rf"(?<=[.!?])(?<!(?:^|\s)(?i:{short})[.]{{1,20}}) (?=[A-Z0-9$])")
    clean = F.transform(parts, lambda s: F.regexp_replace(s, r"\s+[.!?,;:\-—–]+\s*$", ""))
    return F.filter(clean, lambda s: (F.length(s) >= 3) & ~s.rlike(r"^[\s.!?,;:\-—–]+$"))


def top_in_order(rows: DataFrame, keys: Sequence[str], at: str, sentence: str, vector: str, query: str, k: int = 2) -> DataFrame:
    """keys, sentences: each group's k sentences nearest to its query vector, in the order in which they stand."""
    best = latest_n(rows.withColumn("_sim", cosine(F.col(vector), F.col(query))), keys, [F.desc_nulls_last("_sim"), F.col(at)], k)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, sentence))), lambda s: s[sentence]).alias("sentences"))


def heading_chunks(docs: DataFrame, doc_id: str, text: str, size: int = 600, overlap: int = 80) -> DataFrame:
    """doc_id, ord (from 0), section (null without a heading), chunk: each section as it stands, or windows of `size` words that share `overlap`. Lines that start with # are headings; sections without text go."""

    def section(piece: Column) -> Column:
        head = piece.startswith("#")
        body = F.trim(F.when(head, F.regexp_replace(piece, r"\A[^\r\n]*", "")).otherwise(piece), F.lit(" \t\r\n"))
        title = F.trim(F.regexp_extract(piece, r"\A#+([^\r\n]*)", 1))
        return F.struct(F.when(head & (title != ""), title).alias("section"), body.alias("body"), F.split(body, r"\s+").alias("words"))

    def windows(s: Column) -> Column:
        last = F.ceil((F.size(s["words"]) - size) / (size - overlap)).cast("int")
        long = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(s["words"], i * (size - overlap) + 1, size), " "))
        return F.transform(F.when(F.size(s["words"]) <= size, F.array(s["body"])).otherwise(long), lambda c: F.struct(s["section"].alias("section"), c.alias("chunk")))

    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?m)^(?=#)"), section), lambda s: s["body"] != "")
    return docs.select(doc_id, F.posexplode(F.flatten(F.transform(parts, windows))).alias("ord", "_c")).select(doc_id, "ord", "_c.section", "_c.chunk")


def _mentioned(shared, id_type: pa.DataType):
    def run(batches):
        ids = shared.value
        automaton = ahocorasick.Automaton()
        for title in ids:
            automaton.add_word(title, title)
        automaton.make_automaton()
        for b in batches:
            rows, found = [], []
            for k in range(b.num_rows):
                text = b["_text"][k].as_py()
                for title in {t for _, t in automaton.iter(text)} if text else ():
                    rows += [k] * len(ids[title])
                    found += ids[title]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, id_type)], [b.schema.names[0], "title_id"])

    return run


def mentions(docs: DataFrame, doc_id: str, text: str, titles: DataFrame, title_id: str, title: str, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, title_id where the text holds the title, in any case; titles of under three characters are found nowhere.

    Titles are dealt into blocks of about block_bytes of text; each goes to all workers in turn, as one automaton that finds
    all of its titles in one pass over a text. A title or piece that every text has is no more work than another. Null
    texts and titles meet nothing; each pair comes once however often rows are repeated.
    """
    spark = docs.sparkSession
    low = docs.select(doc_id, F.lower(text).alias("_text"))
    names = titles.select(title_id, F.lower(title).alias("_title")).where(F.length("_title") >= 3).distinct()
    blocks = max(1, -(-(names.agg(F.sum(F.octet_length("_title") + 64)).first()[0] or 0) // block_bytes))
    kind = titles.schema[title_id].dataType
    schema = T.StructType([docs.schema[doc_id], T.StructField("title_id", kind)])
    out = None
    for k in range(blocks):
        ids: dict[str, list] = {}
        for r in names.where(F.pmod(F.xxhash64("_title"), F.lit(blocks)) == k).toLocalIterator():
            ids.setdefault(r["_title"], []).append(r[title_id])
        if not ids:
            continue
        part = low.mapInArrow(_mentioned(spark.sparkContext.broadcast(ids), to_arrow_type(kind)), schema)
        out = part if out is None else out.unionByName(part)
    return (spark.createDataFrame([], schema) if out is None else out).distinct().withColumnRenamed("title_id", title_id)


def edge_counts(edges: DataFrame, kind: str) -> DataFrame:
    """kind, n of the edges, and their total where kind is null."""
    return edges.rollup(kind).agg(F.count(F.lit(1)).alias("n"))


def graph_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_clusters (distinct), n_ranked, n_edges. nodes: cluster_id, citation_rank."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("cluster_id").alias("n_clusters"), F.count("citation_rank").alias("n_ranked"))
    return n.join(edges.agg(F.count(F.lit(1)).alias("n_edges")))  # one row each


def weighted_mode(rows: DataFrame, keys: Sequence[str], value: str, weight: Column) -> DataFrame:
    """keys, mode: the value with the greatest sum of weights, the greatest of several."""
    sums = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(*keys).agg(F.max_by(value, F.struct("_w", value)).alias("mode"))


def first_aliases(aliases: DataFrame) -> DataFrame:
    """alias, canonical: the first name by characters where notes claim the same alias."""
    return aliases.groupBy("alias").agg(F.min("canonical").alias("canonical"))


def known_tickers(text: Column, known: Sequence[str], stop: Sequence[str] = ()) -> Column:
    """Words of one to five capitals that are known and not stopped, each once in the order of first sight."""
    wanted = [k for k in known if k not in set(stop)]
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z]{1,5})\b"), 1))
    return F.filter(found, lambda w: w.isin(*wanted))
