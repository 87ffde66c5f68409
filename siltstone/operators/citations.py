"""Citations: quotes checked against their source, links between documents, dead links, changes of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Typographic marks and what they are read as (fixed values).
_MARKS = "‘’‚‛“”„–—− "
_PLAIN = "''''\"\"\"--- "
#: Characters other than blanks that a quote must have to be told from chance.
MIN_QUOTE = 12


def folded(text: Column) -> Column:
    """text in lower case with plain marks and single blanks."""
    plain = F.regexp_replace(F.translate(text, _MARKS, _PLAIN), "…", "...")
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def quote_status(quote: Column, text: Column, loose_ends: bool = False) -> Column:
    """match, not_found, or why a quote can't be checked: no_quote, no_chunk_text, too_short.

    The parts of a quote between ellipses must stand in the text in their order; a quote of one part must stand there as it
    is, with ellipses at its ends, unless loose_ends lets these stand for nothing.
    """
    q, t = folded(F.coalesce(quote, F.lit(""))), folded(F.coalesce(text, F.lit("")))
    parts = F.filter(F.split(q, r"\s*\.{3,}\s*" if loose_ends else r"\s*\.\.\.\s*"), lambda x: F.length(F.trim(x)) > 0)

    def step(at: Column, part: Column) -> Column:
        hit = F.call_function("locate", part, t, at)
        return F.when((at > 0) & (hit > 0), hit + F.length(part)).otherwise(0)

    end = F.aggregate(parts, F.lit(1), step)
    return (
        F.when(F.length(q) == 0, "no_quote").when(F.length(t) == 0, "no_chunk_text")
        .when(F.length(F.replace(q, F.lit(" "), F.lit(""))) < MIN_QUOTE, "too_short")
        .when(F.when(F.lit(loose_ends) | (F.size(parts) > 1), end > 0).otherwise(F.call_function("locate", q, t) > 0), "match").otherwise("not_found")
    )


def citation_rollup(rows: DataFrame, key: str, status: str) -> DataFrame:
    """key, state: mismatch before verified before unverifiable before no_quotes."""
    g = rows.groupBy(key).agg(
        F.bool_or(F.col(status) == "not_found").alias("_bad"), F.bool_or(F.col(status) == "match").alias("_good"),
        F.bool_or(F.col(status).isin("too_short", "no_chunk_text")).alias("_open"),
    )
    return g.select(key, F.when(F.col("_bad"), "mismatch").when(F.col("_good"), "verified").when(F.col("_open"), "unverifiable").otherwise("no_quotes").alias("state"))


def links(docs: DataFrame, key: str, text: str, pattern: str = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]") -> DataFrame:
    """src, dst, weight: the targets (group 1 of pattern) that each document names, with how often; not itself."""
    found = docs.select(F.col(key).alias("src"), F.explode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("dst")).withColumn("dst", F.trim("dst"))
    return found.where((F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def dead_links(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """dst, n_sources of targets that aren't nodes."""
    gone = edges.join(nodes.select(F.col(key).alias("dst")), "dst", "left_anti")
    return gone.groupBy("dst").agg(F.count_distinct("src").alias("n_sources"))


def index_changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change (added, changed, unchanged, dropped) from the digests of both sides; keys are unique on each."""
    both = old.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_was")).join(new.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_is")), key, "full")
    change = F.when(F.col("_is").isNull(), "dropped").when(F.col("_was").isNull(), "added").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return both.select(key, change.alias("change"))


def replace_edges(edges: DataFrame, fresh: DataFrame, changed: DataFrame, key: str, owned: list[str]) -> DataFrame:
    """edges with those of the owned kinds from changed sources replaced by fresh; other kinds stay."""
    mine = changed.select(F.col(key).alias("src"), F.lit(True).alias("_mine"))
    kept = edges.join(mine, "src", "left").where(F.col("_mine").isNull() | ~F.col("kind").isin(*owned)).select(*edges.columns)
    return kept.unionByName(fresh)
