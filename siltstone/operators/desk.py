"""Joins and roll-ups of the research desk: bands, memberships, links, folders, lookups, costs, rates and orders."""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import rules
from siltstone.operators.timeseries import latest_n
from siltstone.operators.trading import tier


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, ts: str, seconds: int) -> DataFrame:
    """Pairs of left and right rows of equal keys with ts at most `seconds` before or after `at`; other columns differ in name.

    Time is cut into buckets as wide as a band, which a band touches two of: keys and bucket are an equi-join, so a hot
    key is spread over its buckets, and no row meets all rows of its key. Null keys and times pair with nothing.
    """
    wide = 2 * seconds * 1_000_000
    mid, when = (F.unix_micros(F.col(c).cast("timestamp")) for c in (at, ts))
    lo, hi = (F.floor((mid + sign * seconds * 1_000_000) / F.lit(wide)) for sign in (-1, 1))
    l_rows = left.where(F.col(at).isNotNull()).withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    r_rows = right.withColumn("_bucket", F.floor(when / F.lit(wide)))
    return l_rows.join(r_rows, [*keys, "_bucket"]).where(F.abs(when - mid) <= seconds * 1_000_000).drop("_bucket")


def close_links(trades: DataFrame, items: DataFrame, linked: DataFrame, seconds: int = 86_400) -> DataFrame:
    """trade_id, item_id, pnl, win, closed_at of items captured about a closed trade's entry that aren't linked yet.

    trades: trade_id, ticker, entry_at, exit_at, pnl. items: item_id, ticker, captured_at. linked: trade_id, item_id. win is null with the pnl.
    """
    closed = trades.where(F.col("exit_at").isNotNull()).select("trade_id", "ticker", "entry_at", F.col("exit_at").alias("closed_at"), "pnl")
    met = band_join(closed, items.select("item_id", "ticker", "captured_at"), ["ticker"], "entry_at", "captured_at", seconds)
    fresh = met.join(linked.select("trade_id", "item_id"), ["trade_id", "item_id"], "left_anti")
    return fresh.select("trade_id", "item_id", "pnl", (F.col("pnl") > 0).alias("win"), "closed_at").distinct()


def member_rates(wanted: DataFrame, key: str, rows: DataFrame, members: str, hit: Column, counted: Column) -> DataFrame:
    """key, n, rate: of the counted rows whose array names the key, the share with hit; 0 without any. An array that names a key twice counts twice."""
    each = rows.where(counted).select(F.explode(members).alias(key), hit.alias("_hit"))
    g = each.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_hit").cast("int")).alias("rate"))
    return wanted.select(key).join(g, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rate", F.lit(0.0)).alias("rate"))


def resolve_links(edges: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """edges (src, dst) with path: the node that dst names, else null.

    A name is first replaced by its alias (alias, canonical). It is a path, or one without .md, or else the last part of one
    in any case of A-Z; of several the first path counts. Paths of nodes and aliases are unique.
    """
    named = edges.withColumn("_name", F.col("dst"))
    if aliases is not None:
        named = edges.join(aliases.select(F.col("alias").alias("dst"), "canonical"), "dst", "left").withColumn("_name", F.coalesce("canonical", "dst")).drop("canonical")

    def stem(c: Column) -> Column:
        last = F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?<=.)\.[^.]*$", "")
        return F.translate(last, string.ascii_uppercase, string.ascii_lowercase)

    paths = nodes.select("path")
    exact = paths.select(F.col("path").alias("_name"), F.col("path").alias("_exact"))
    dotted = paths.where(F.col("path").endswith(".md")).select(F.expr("left(path, length(path) - 3)").alias("_name"), F.col("path").alias("_dotted"))
    ends = paths.where(F.col("path").endswith(".md")).groupBy(stem(F.col("path")).alias("_stem")).agg(F.min("path").alias("_end"))
    found = named.join(exact, "_name", "left").join(dotted, "_name", "left").withColumn("_stem", stem(F.col("_name"))).join(ends, "_stem", "left")
    return found.select(*edges.columns, F.coalesce("_exact", "_dotted", "_end").alias("path"))


def folder_contexts(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """context, depth, path: the index note of each folder above a path that exists among the nodes (path, kind), the root's at depth 0."""
    parts = F.split("path", "/")
    rows = paths.select("path", parts.alias("_p"), F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("depth"))
    folder = F.concat(F.array_join(F.slice("_p", 1, F.col("depth")), "/"), F.when(F.col("depth") > 0, "/").otherwise(""), F.lit("_index.md"))
    known = nodes.where(F.col("kind") == "folder_context").select(F.col("path").alias("context"))
    return rows.select(folder.alias("context"), "depth", "path").join(known, "context", "left_semi")


def counts_for(all_keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """key, n: rows of each key, 0 where it has none."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return all_keys.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def lookup(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """wanted (its ordinal, key) with the rows' columns, which are null for keys that rows lack; repeats stay. Keys of rows are unique."""
    return wanted.join(rows, key, "left")


def task_grid(items: DataFrame, **choices: Sequence[str]) -> DataFrame:
    """items for each combination of the listed choices, each a column under its name; no join."""
    return reduce(lambda df, c: df.withColumn(c[0], F.explode(F.array(*[F.lit(v) for v in c[1]]))), choices.items(), items)


def untouched_since(keys: DataFrame, rows: DataFrame, key: str, ts: str, since: Column) -> DataFrame:
    """The keys without a row at or after `since`."""
    return keys.join(rows.where(F.col(ts) >= since).select(key), key, "left_anti")


def monthly_costs(research: DataFrame, research_cost: Column, vision: DataFrame, vision_cost: Column, ts: str) -> DataFrame:
    """month, totals and counts of both kinds and the total, to four places.

    All research rows are counted, and vision rows whose cost isn't null; what is no number adds nothing.
    """
    parts = [df.select(F.date_format(ts, "yyyy-MM").alias("month"), c.cast("string").alias("_cost"), F.lit(k).alias("_kind")) for k, (df, c) in enumerate(((research, research_cost), (vision, vision_cost)))]
    cost = F.coalesce(F.col("_cost").try_cast("double"), F.lit(0.0))
    r, v = F.col("_kind") == 0, F.col("_kind") == 1
    g = parts[0].unionByName(parts[1]).groupBy("month").agg(
        F.round(F.sum(F.when(r, cost).otherwise(0.0)), 4).alias("research_total"), F.count_if(r).alias("research_count"),
        F.round(F.sum(F.when(v, cost).otherwise(0.0)), 4).alias("vision_total"), F.count_if(v & F.col("_cost").isNotNull()).alias("vision_count"),
        F.round(F.sum(cost), 4).alias("total"),
    )
    return g.where((F.col("research_count") > 0) | (F.col("vision_count") > 0))


def totals_per(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """key and the sum of its values; keys and values that are null are left out."""
    return rows.where(F.col(key).isNotNull() & value.isNotNull()).groupBy(key).agg(F.sum(value).alias(name))


def attribution_counts(rows: DataFrame, kind: str, known: Sequence[str]) -> DataFrame:
    """kind, n: rows of each known kind; null and unknown ones are unclassified."""
    named = F.when(F.col(kind).isin(*known), F.col(kind)).otherwise("unclassified")
    return rows.groupBy(named.alias(kind)).agg(F.count(F.lit(1)).alias("n"))


def latest_with_count(rows: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """keys, last_value (of the last time; the largest of several), last_at, n."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(ts, value)).alias("last_value"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("n"))


def week_change(rows: DataFrame, keys: Sequence[str], ts: str, value: str, back: int = 5) -> DataFrame:
    """keys, last_value, pct from the value `back` rows before it; pct is null for shorter series and bases that aren't positive."""
    last = latest_n(rows, keys, [F.desc(ts)], back + 1)
    g = last.groupBy(*keys).agg(F.max_by(value, ts).alias("last_value"), F.min_by(value, ts).alias("_base"), F.count(F.lit(1)).alias("_n"))
    pct = F.when((F.col("_n") > back) & (F.col("_base") > 0), (F.col("last_value") - F.col("_base")) / F.col("_base") * 100)
    return g.select(*keys, "last_value", pct.alias("pct"))


def crowding(ranked: DataFrame, day: str, item: str, place: str, defensive: Sequence[str], first: int = 3, least: int = 2) -> DataFrame:
    """day, n_defensive among the first places, crowded (`least` or more)."""
    g = ranked.where(F.col(place) <= first).groupBy(day).agg(F.count_if(F.col(item).isin(*defensive)).alias("n_defensive"))
    return g.withColumn("crowded", F.col("n_defensive") >= least)


def with_risk(rows: DataFrame, expires: str, now: Column, days: int = 30) -> DataFrame:
    """rows with days_left (whole days, rounded down), at_risk (expires within `days`) and reason; an item that never expires isn't at risk."""
    left = F.unix_micros(F.col(expires).cast("timestamp")) - F.unix_micros(now)
    at_risk = F.coalesce(left < days * 86_400_000_000, F.lit(False))
    return rows.withColumns({"days_left": F.floor(left / 86_400_000_000), "at_risk": at_risk, "reason": F.when(at_risk, "at_risk").otherwise("scheduled")})


def most_urgent(rows: DataFrame, tie: str, n: int) -> DataFrame:
    """The n first rows of with_risk() with their place from 1: those at risk first, then by days left, those without an end last."""
    order = [F.desc("at_risk"), F.asc_nulls_last("days_left"), F.col(tie)]
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def capped_union(parts: Sequence[DataFrame], key: str, order: str, cap: int) -> DataFrame:
    """key, part, place (from 1) of the first `cap` distinct keys, an earlier part's first, in the order of a column."""
    every = reduce(DataFrame.unionByName, [df.select(key, F.lit(i).alias("part"), F.col(order).alias("_at")) for i, df in enumerate(parts)])
    once = every.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("part", "_at")).alias("_first"))
    by = [F.col("_first"), F.col(key)]
    best = once.orderBy(*by).limit(cap).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)))
    return best.select(key, F.col("_first.part").alias("part"), "place")


def orphan_tags(rows: DataFrame, tags: str, vocabulary: Sequence[str]) -> DataFrame:
    """tag, n: rows that carry a tag outside the vocabulary, each row once for a tag."""
    each = rows.select(F.explode(F.array_distinct(tags)).alias("tag"))
    return each.where(F.col("tag").isNotNull() & ~F.col("tag").isin(*vocabulary)).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def tier_rows(rows: DataFrame, channels: str, trailblazers: str, is_etf: Column | None) -> DataFrame:
    """rows that have a tier, with it; ETFs are left out where is_etf is given."""
    kept = rows if is_etf is None else rows.where(~F.coalesce(is_etf, F.lit(False)))
    return kept.withColumn("tier", tier(F.col(channels), F.col(trailblazers))).where(F.col("tier").isNotNull())


def class_status(rows: DataFrame, keys: Sequence[str], ts: str, status: str, statuses: Sequence[str]) -> DataFrame:
    """keys, n, oldest and a count for each listed status, in one pass."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("oldest"), *[F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in statuses])


def timeline(rows: DataFrame, column: str, name: str) -> DataFrame:
    """The rows of all snapshots whose column is the name, without blanks around it and in any case."""
    return rows.where(F.lower(F.trim(column)) == name.strip().lower())


def recall_delta(fast: DataFrame, deep: DataFrame, query: str, path: str) -> DataFrame:
    """query, n_fast, n_deep, n_both, n_only_fast, n_only_deep of the distinct paths that the two searches return."""
    found = fast.select(query, path, F.lit(1).alias("_f"), F.lit(0).alias("_d")).unionByName(deep.select(query, path, F.lit(0).alias("_f"), F.lit(1).alias("_d")))
    one = found.groupBy(query, path).agg(F.max("_f").alias("_f"), F.max("_d").alias("_d"))
    f, d = F.col("_f") == 1, F.col("_d") == 1
    return one.groupBy(query).agg(*[F.count_if(c).alias(n) for n, c in (("n_fast", f), ("n_deep", d), ("n_both", f & d), ("n_only_fast", f & ~d), ("n_only_deep", d & ~f))])


def claim_credibility(claims: DataFrame, claim: str, claimed: str, sources: DataFrame, publisher: str, tier_name: str) -> DataFrame:
    """claim, publishers, credibility of each claim by its sources; an unknown tier is the lowest, an empty publisher none."""
    rank = F.coalesce(*[F.when(F.lower(tier_name) == t, F.lit(r)) for t, r in rules.TIER_RANK.items()], F.lit(1))
    g = sources.groupBy(claim).agg(F.count_distinct(F.when(F.length(publisher) > 0, F.col(publisher))).alias("publishers"), F.max(rank).alias("_best"))
    both = claims.join(g, claim, "left").withColumn("publishers", F.coalesce("publishers", F.lit(0)))
    return both.select(claim, "publishers", rules.credibility(F.col("publishers"), F.coalesce("_best", F.lit(0)), F.col(claimed)).alias("credibility"))
