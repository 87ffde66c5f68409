"""The queries op1 to op13 with their production parameters, and SQL where SQL can express them."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import scratch

#: The public vocabularies' files.
BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text, a row for each row: a null text is empty, null ids and repeated rows stay, other columns are ignored. An empty table gives no rows."""
    from siltstone.llm.secret_scan import secret_scan

    return secret_scan(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for each row, repeated rows alike: null texts and those without a letter get und and 0. Rows with a null id or language aren't learned from. An empty table gives no rows."""
    from siltstone.llm import langid

    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    rows = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.predict(rows, model).drop("text")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row: null and empty texts are one group; of rows with the same id and text one is kept; an id counts before none. An empty table gives no rows."""
    from siltstone.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and checksums read back from the files, a row for each row by doc_id: a null text is its end id alone, null ids come first, repeated ids keep all their rows. An empty table gives no rows."""
    from siltstone.llm.token_records import read_token_records, write_token_records

    folder = scratch(spark, "token-records")
    write_token_records(_table(spark, sf_dir, "documents"), folder, BYTE_BPE, end_id=2)
    return read_token_records(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows, a row for each row, by its own text: null texts have no words; benchmark rows without an id are left out, repeated items count once. An empty table gives no rows."""
    from siltstone.llm.decontam import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("word_spans")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each row: null and wordless texts link with nothing; repeated rows are in one group; a null id never names a group that has another id. An empty table gives no rows."""
    from siltstone.llm.ngram_join import similarity_groups

    return similarity_groups(_table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and notices in every text, a row for each row: a null text has no words; repeated rows get the same answer. An empty table gives no rows."""
    from siltstone.llm.license_scan import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences: a null text is its end id alone; repeated rows are packed each; pieces of equal lengths go in any order. An empty table gives no rows."""
    from siltstone.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), WORD_BPE, end_id=1, size=4096)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache, so that a run's figures don't hang on earlier runs."""
    from siltstone.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), BYTE_BPE, scratch(spark, "count-cache"), limit=1024)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back from the shards, a row for each row, whatever is null in it. An empty table gives no rows."""
    from siltstone.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), scratch(spark, "shards"), arrivals=4, target=128 << 20)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents and labels that aren't held out; scores every document."""
    from siltstone.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, _table(spark, sf_dir, "labels")))
    return toxicity.predict(docs.select("doc_id", toxicity.held_out().alias("held_out"), "text"), model)


def with_loops(doc_id: int | None, words: list[str]) -> list[str]:
    """The words that the contract of op12 has looked at: a tenth of the documents get a tail that repeats. Without an id, the words stay."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the runs and of the collapsed words of every document, with its run of the greatest exponent."""
    from siltstone.llm.periodic_runs import periodic_runs

    found = periodic_runs(_table(spark, sf_dir, "documents"), least_length=6, exponent=4, edit=with_loops)
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the outputs, and of the texts rebuilt from the outputs."""
    from siltstone.llm.fill_in_middle import fill_in_middle, restore

    made = fill_in_middle(_table(spark, sf_dir, "documents"), unit="chars", salt="1", plain=10, spm=20)
    back = restore(made.withColumn("output_sha256", F.sha2(F.col("output"), 256)))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(F.col("restored"), 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_language_id, op3_exact_dedup, op4_token_records, op5_decontamination, op6_ngram_join, op7_license_scan, op8_best_fit_packing, op9_token_counts, op10_sharding, op11_toxicity, op12_periodic_runs, op13_fill_in_middle)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOW}) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d""",
    "op5_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        windows AS (
            SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS words
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0) AS starts),
        places AS (
            SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS words
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM windows) AS lengths) AS starts),
        found AS (SELECT r, i, n, item FROM places JOIN windows USING (n, words)),
        hit AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS word FROM found) AS hit_words GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named FROM (SELECT DISTINCT r, item FROM found) AS pairs GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(named, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
    "op13_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
            FROM documents),
        u AS (
            SELECT doc_id, t, n, list_transform([1, 9, 17, 25], lambda k: CAST(concat('0x', substr(h, k, 8)) AS BIGINT)) AS u
            FROM d),
        f AS (
            SELECT doc_id, t, n, least(u[1] % (n + 1), u[2] % (n + 1)) AS a, greatest(u[1] % (n + 1), u[2] % (n + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR u[3] % 100 >= 90 THEN 'plain'
                        WHEN u[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM u),
        o AS (
            SELECT *, CASE form WHEN 'plain' THEN t
                                WHEN 'psm' THEN concat('<P>', substr(t, 1, a), '<S>', substr(t, b + 1), '<M>', substr(t, a + 1, b - a))
                                ELSE concat('<S>', substr(t, b + 1), '<P>', substr(t, 1, a), '<M>', substr(t, a + 1, b - a)) END AS output
            FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(output) AS output_sha256, sha256(t) AS restored_sha256
        FROM o""",
}
