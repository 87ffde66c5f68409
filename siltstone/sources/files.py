"""Files that the platform reads: bars as JSON, smart-money tables, fund holdings, captions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the tables without a header (fixed values).
POLITICIANS = ("disclosed", "traded", "ticker", "company", "age", "fv", "member", "party", "district", "committee", "value_range")
INSIDERS = ("date", "ticker", "company", "age", "person", "title", "value", "shares", "price", "sign")
OPTIONS = ("date", "ticker", "company", "age", "fv", "signal", "conviction", "contract", "premium", "ratio")


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A tab-separated table without a header, all columns as trimmed strings, tickers in upper case; rows that are short or have no ticker go."""
    parts = spark.read.text(path).select(F.split("value", "\t", -1).alias("_parts")).where(F.size("_parts") >= len(columns))
    rows = parts.select(*[F.trim(F.get("_parts", F.lit(i))).alias(c) for i, c in enumerate(columns)])
    return rows.withColumn("ticker", F.upper("ticker")).where(F.length("ticker") > 0)


def read_tsv_with_header(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table whose first line names its columns, all as strings."""
    return spark.read.csv(path, sep="\t", header=True, quote="")


def read_holdings(spark: SparkSession, path: str) -> DataFrame:
    """fund, ticker, company, status from a JSON object of funds and their holdings as tab-separated strings."""
    text = spark.read.text(path, wholetext=True)
    funds = text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("fund", "_rows"))
    part = F.split("_row", "\t")
    return funds.select("fund", F.explode("_rows").alias("_row")).select("fund", *[F.trim(F.get(part, F.lit(i))).alias(c) for i, c in enumerate(("ticker", "company", "status"))])


def read_daily_bars(spark: SparkSession, path: str) -> DataFrame:
    """symbol, ts, open, high, low, close, volume, amount from JSON files of daily series by date.

    The amount isn't in these files: it is close times volume. Bars without a number for close are left out.
    """
    schema = "`Meta Data` map<string, string>, `Time Series (Daily)` map<string, map<string, string>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("_j"))
    rows = text.select(F.col("_j")["Meta Data"]["2. Symbol"].alias("symbol"), F.explode(F.col("_j")["Time Series (Daily)"]).alias("_day", "_bar"))
    numbers = {"open": "1. open", "high": "2. high", "low": "3. low", "close": "4. close", "volume": "5. volume"}
    bars = rows.select("symbol", F.col("_day").try_cast("date").alias("ts"), *[F.col("_bar")[k].try_cast("double").alias(c) for c, k in numbers.items()])
    return bars.where("close is not null").withColumn("amount", F.col("close") * F.col("volume"))


def read_macro_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """symbol, ts, value from a two-column CSV with a header; a value of . is missing and its row goes."""
    rows = spark.read.csv(path, header=True, schema="ts string, value string", enforceSchema=True)
    return rows.select(F.lit(symbol).alias("symbol"), F.col("ts").try_cast("date").alias("ts"), F.col("value").try_cast("decimal(20,8)").alias("value")).where("value is not null and ts is not null")


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """path, start_s, text of each cue of WebVTT files, tags taken out and blanks folded; empty cues go."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    cue = r"(?:(\d+):)?(\d{2}):(\d{2}\.\d{3})\s+-->[^\n]*\n([^\n]+(?:\n[^\n]+)*)"
    blocks = files.select("path", F.explode(F.regexp_extract_all(F.regexp_replace("value", "\r\n?", "\n"), F.lit(cue), 0)).alias("_cue"))
    g = [F.regexp_extract("_cue", cue, i) for i in range(5)]
    start = F.coalesce(g[1].try_cast("double"), F.lit(0.0)) * 3600 + g[2].cast("double") * 60 + g[3].cast("double")
    words = F.trim(F.regexp_replace(F.regexp_replace(g[4], "<[^>]*>", ""), r"\s+", " "))
    return blocks.select("path", start.alias("start_s"), words.alias("text")).where(F.length("text") > 0)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """path, name, front (its simple "key: value" lines as a map), title, body, body_hash of Markdown files; a title defaults to the name without its end."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    notes = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "value")
    block = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\z)", 1)
    body = F.trim(F.regexp_replace("value", r"(?s)\A---\r?\n.*?---[ \t]*(?:\r?\n|\z)", ""), F.lit(" \t\r\n"))
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_]\w*:"))
    pair = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^\w+:", "")), "^([\"'])(.*)\\1$", "$2").alias("value")))
    # the last line of a key counts
    front = F.aggregate(pair, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))
    rows = notes.select("path", "name", front.alias("front"), body.alias("body"))
    title = F.coalesce(F.nullif(F.try_element_at("front", F.lit("title")), F.lit("")), F.regexp_replace("name", r"\.md$", ""))
    return rows.select("path", "name", "front", title.alias("title"), "body", F.substring(F.sha2("body", 256), 1, 16).alias("body_hash"))


def read_feed(spark: SparkSession, path: str, atom: bool = False) -> DataFrame:
    """title, link, published, summary of an RSS feed's items or an Atom feed's entries, all as strings."""
    link = "struct<_href: string>" if atom else "string"
    names = ("updated", "summary") if atom else ("pubDate", "description")
    rows = spark.read.format("xml").option("rowTag", "entry" if atom else "item").schema(f"title string, link {link}, {names[0]} string, {names[1]} string").load(path)
    return rows.select(F.trim("title").alias("title"), F.col("link._href" if atom else "link").alias("link"), F.col(names[0]).alias("published"), F.col(names[1]).alias("summary"))


def latest_snapshot(rows: DataFrame, day: str) -> DataFrame:
    """The rows of the newest snapshot, and the snapshots' days are their distinct values."""
    newest = rows.agg(F.max(day).alias(day))
    return rows.join(F.broadcast(newest), day)  # one row
