"""Signals, trades and recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.timeseries import numbered


def fire_rules(rows: DataFrame, rules: dict[str, tuple[Column, Column]], keep: Sequence[str]) -> DataFrame:
    """keep, rule, score: a row for each rule (name: condition, score) that a row meets."""
    hits = F.array(*[F.when(cond, F.struct(F.lit(name).alias("rule"), score.cast("double").alias("score"))) for name, (cond, score) in rules.items()])
    return rows.select(*keep, F.explode(F.array_compact(hits)).alias("_h")).select(*keep, "_h.rule", "_h.score")


def positions(trades: DataFrame, key: str, quotes: DataFrame, min_total: float = 5000, min_n: int = 4, share: float = 0.05) -> DataFrame:
    """Open positions by key from trades (qty signed, price): value at the quote or else the average price, gain, share of the total, flag.

    The flag needs a total of min_total, min_n positions and a share above `share`.
    """
    held = trades.groupBy(key).agg(F.sum("qty").alias("qty"), F.sum(F.col("qty") * F.col("price")).alias("cost")).where("qty != 0")
    held = held.join(quotes.select(key, "quote"), key, "left")
    avg = F.abs(F.col("cost") / F.col("qty"))
    value = F.coalesce("quote", avg) * F.abs("qty")
    rows = held.withColumns({"avg_price": avg, "value": value})
    # the totals are one row: a small aggregate joined back, not a window over everything
    total = rows.agg(F.sum("value").alias("_total"), F.count(F.lit(1)).alias("_n"))
    rows = rows.join(F.broadcast(total))
    pct = F.col("value") / F.col("_total")
    gain = F.col("value") - F.abs("cost")
    return rows.select(
        key, "qty", "avg_price", "value", gain.alias("unrealized"), pct.alias("pct"),
        ((F.col("_total") >= min_total) & (F.col("_n") >= min_n) & (pct > share)).alias("flagged"),
    )


def creditable(trades: DataFrame, kind: str) -> DataFrame:
    """Trades that weren't influenced by a recommendation; those of unknown kind stay."""
    return trades.where(~F.col(kind).eqNullSafe("influenced"))


def action_rate(rows: DataFrame, keys: Sequence[str], acted: Column, skipped: Column) -> DataFrame:
    """keys, n_acted, n_skipped, rate (null without either), band: green from .30, yellow from .15, else red, null unknown."""
    g = rows.groupBy(*keys).agg(F.count_if(acted).alias("n_acted"), F.count_if(skipped).alias("n_skipped"))
    rate = F.col("n_acted") / F.nullif(F.col("n_acted") + F.col("n_skipped"), F.lit(0))
    band = F.when(F.col("rate") >= 0.30, "green").when(F.col("rate") >= 0.15, "yellow").when(F.col("rate").isNotNull(), "red").otherwise("unknown")
    return g.withColumn("rate", rate).withColumn("band", band)


def engagement_vs_value(rates: DataFrame, pnl: DataFrame, key: str) -> DataFrame:
    """key, rate, value, diverges: acted on often (.30 or more) yet losing."""
    return rates.join(pnl, key).select(key, "rate", "value", ((F.col("rate") >= 0.30) & (F.col("value") < 0)).alias("diverges"))


def slope(rows: DataFrame, keys: Sequence[str], order: str, value: str, dead: float = 0.05) -> DataFrame:
    """keys, n, slope on the row number (0 for fewer than two rows), direction with a dead zone."""
    w = Window.partitionBy(*keys).orderBy(order)
    g = rows.withColumn("_i", F.row_number().over(w) - 1).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(value, "_i").alias("_s"))
    s = F.coalesce("_s", F.lit(0.0))
    return g.select(*keys, "n", s.alias("slope"), F.when(s > dead, "up").when(s < -dead, "down").otherwise("flat").alias("direction"))


def attention(items: DataFrame, key: str, kind: str, ts: str, weights: dict[str, float], now: Column, half_life_days: float = 7, window_days: float = 14) -> DataFrame:
    """key, n_items, attention: weights of the items of the last window_days, each halved every half_life_days."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 86_400_000_000
    weight = F.coalesce(*[F.when(F.col(kind) == k, F.lit(float(w))) for k, w in weights.items()], F.lit(0.0))
    rows = items.withColumns({"_age": age, "_w": weight}).where((F.col("_age") <= window_days) & (F.col("_age") >= 0))
    decay = F.exp(-F.lit(0.6931471805599453) * F.col("_age") / half_life_days)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col("_w") * decay).alias("attention"))


def composite_score(action: Column, at_risk: Column, recent: Column, cost: Column, dismiss: Column, age_days: Column) -> Column:
    """The research ranking: weights are fixed values."""
    clamp = F.least(F.greatest(dismiss, F.lit(0.0)), F.lit(1.0))
    return action + 0.8 * at_risk + 0.6 * recent + 0.4 * F.log1p(cost) - 0.5 * clamp - 0.05 * age_days


def defer_beyond(df: DataFrame, keys: Sequence[str], score: str, tie: str, n: int = 5) -> DataFrame:
    """df with place (by score, nulls last) and is_deferred: place above n."""
    rows = numbered(df.drop("place"), keys, [F.desc_nulls_last(score), F.col(tie)], "place")
    return rows.withColumn("place", F.col("place").cast("int")).withColumn("is_deferred", F.col("place") > n)


def merge_channels(channels: dict[str, DataFrame], key: str, company: str) -> DataFrame:
    """key, n_channels, n_signals, company (of the first channel that names one), channels: one pass over the tagged union."""
    parts = [df.select(F.upper(F.trim(key)).alias(key), F.col(company).alias("_company"), F.lit(i).alias("_i"), F.lit(name).alias("_name")) for i, (name, df) in enumerate(channels.items())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    named = F.when(F.length(F.trim("_company")) > 0, F.struct("_i", "_company"))
    return every.where(F.length(key) > 0).groupBy(key).agg(
        F.count_distinct("_name").alias("n_channels"), F.count(F.lit(1)).alias("n_signals"), F.min(named)["_company"].alias("company"),
        F.array_join(F.array_sort(F.collect_set("_name")), ",").alias("channels"),
    )


def tier(n_channels: Column, second: Column) -> Column:
    """1 for four channels or more, 2 for three, 3 for two with five of the second kind; else null."""
    return F.when(n_channels >= 4, 1).when(n_channels == 3, 2).when((n_channels == 2) & (second >= 5), 3)


def bucket_counts(df: DataFrame, keys: Sequence[str], status: str, buckets: dict[str, Sequence[str]], other: str) -> DataFrame:
    """keys and a count for each bucket of statuses; unlisted ones go to `other`."""
    known = F.coalesce(*[F.when(F.col(status).isin(list(s)), F.lit(b)) for b, s in buckets.items()], F.lit(other))
    names = list(dict.fromkeys([*buckets, other]))
    g = df.withColumn("_b", known).groupBy(*keys)
    return g.agg(*[F.count_if(F.col("_b") == b).alias(f"n_{b}") for b in names])
