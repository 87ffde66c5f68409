"""Hypotheses: expiry, invalidators over all hypotheses at once, and the cascade to what depends on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.shared import settled

#: Each operation and the arguments that it needs (fixed values).
OPERATIONS = {
    "ratio_below_sma": ("symbol", "denominator", "sma_days", "days"),
    "series_above_threshold": ("symbol", "threshold", "days"),
    "series_below_threshold": ("symbol", "threshold", "days"),
    "series_change_pct": ("symbol", "window_months", "threshold", "direction"),
    "manual": (),
    "tv_context_count_since": ("days", "min_count"),
    "tv_context_stance_count_since": ("days", "min_count", "stance"),
}
#: Arguments that must be positive.
_POSITIVE = ("sma_days", "days", "window_months", "min_count")


def spec_error() -> Column:
    """What is wrong with a spec of the columns id, op and the arguments; null if nothing is."""
    out = F.when(F.col("op").isNull() | ~F.col("op").isin(*OPERATIONS), "unknown op")
    for op, args in OPERATIONS.items():
        for a in args:
            bad = F.col(a).isNull() | (F.col(a) <= 0 if a in _POSITIVE else F.lit(False))
            out = out.when((F.col("op") == op) & bad, f"bad {a}")
    return out.when((F.col("op") == "series_change_pct") & ~F.col("direction").isin("up", "down"), "bad direction")


def evaluate(specs: DataFrame, points: DataFrame, contexts: DataFrame, today: Column) -> DataFrame:
    """id, fired of each valid spec (see OPERATIONS), a plan for each operation over all specs of it.

    points: symbol, ts (a date), value. contexts: id, ts, stance. Too short a history never fires, nor does `manual`
    or a change from 0. A series past its threshold: the last `days` values are all strictly past it. A ratio below
    its mean: the last `days` quotients each lie below the mean of the sma_days that end with them.
    """
    good = specs.where(spec_error().isNull())
    known = points.where(F.col("value").isNotNull() & F.col("ts").isNotNull())
    back = Window.partitionBy("id").orderBy(F.desc("ts"))

    streak = good.where(F.col("op").isin("series_above_threshold", "series_below_threshold")).select("id", "op", "symbol", "threshold", "days")
    last = streak.join(known, "symbol").withColumn("_back", F.row_number().over(back)).where("_back <= days")
    past = F.when(F.col("op") == "series_above_threshold", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    parts = [last.groupBy("id").agg((F.count_if(past) == F.first("days")).alias("fired"))]

    pairs = good.where("op = 'ratio_below_sma'").select("id", "symbol", "denominator", "sma_days", "days")
    under = known.select(F.col("symbol").alias("denominator"), "ts", F.col("value").alias("_d")).where("_d <> 0")
    quotients = pairs.join(known, "symbol").join(under, ["denominator", "ts"]).withColumn("_q", F.col("value") / F.col("_d"))
    recent = quotients.withColumn("_back", F.row_number().over(back)).where("_back <= sma_days + days")
    rows = recent.groupBy("id").agg(
        F.first("days").alias("days"), F.first("sma_days").alias("sma_days"),
        F.transform(F.array_sort(F.collect_list(F.struct("_back", "_q"))), lambda x: x["_q"]).alias("_v"),
    )
    mean = lambda i: F.aggregate(F.slice("_v", i, F.col("sma_days")), F.lit(0.0), lambda s, x: s + x) / F.col("sma_days")
    below = F.forall(F.sequence(F.lit(1), F.col("days")), lambda i: F.element_at("_v", i) < mean(i))
    parts.append(rows.select("id", F.when(F.size("_v") >= F.col("sma_days") + F.col("days"), below).otherwise(False).alias("fired")))

    change = good.where("op = 'series_change_pct'").select("id", "symbol", "window_months", "threshold", "direction")
    since = F.date_sub(today, F.col("window_months") * 30 + 14)
    ends = change.join(known, "symbol").where(F.col("ts") >= since).groupBy("id").agg(
        F.first("threshold").alias("_t"), F.first("direction").alias("_way"), F.count(F.lit(1)).alias("_n"),
        F.min_by("value", "ts").alias("_a"), F.max_by("value", "ts").alias("_b"),
    )
    pct = (F.col("_b") - F.col("_a")) / F.nullif(F.col("_a"), F.lit(0)) * 100
    moved = F.when(F.col("_way") == "up", pct >= F.col("_t")).otherwise(pct <= -F.abs("_t"))
    parts.append(ends.select("id", ((F.col("_n") >= 2) & F.coalesce(moved, F.lit(False))).alias("fired")))

    counted = good.where(F.col("op").startswith("tv_context")).select("id", "op", "days", "min_count", F.col("stance").alias("_stance"))
    seen = counted.join(contexts, "id").where((F.col("ts") >= F.date_sub(today, F.col("days"))) & ((F.col("op") == "tv_context_count_since") | (F.col("stance") == F.col("_stance"))))
    parts.append(seen.groupBy("id").agg((F.count(F.lit(1)) >= F.first("min_count")).alias("fired")))

    fired = parts[0]
    for p in parts[1:]:
        fired = fired.unionByName(p)
    return good.select("id").join(fired, "id", "left").select("id", F.coalesce("fired", F.lit(False)).alias("fired"))


def expire(rows: DataFrame, status: str, expires: str, now: Column) -> DataFrame:
    """rows with the status 'expired' where an active one's time is over."""
    return rows.withColumn(status, F.when((F.col(status) == "active") & (F.col(expires) < now), "expired").otherwise(F.col(status)))


def cascade(rows: DataFrame, key: str, parent: str, status: str, passes: int = 10) -> DataFrame:
    """rows with the status 'cancelled' for active rows whose parent isn't active, then for theirs, a level in each pass.

    Each pass joins only the rows that the one before it cancelled; a row has one parent, so none is met twice, and a
    cycle of active rows stays active. Parents that don't exist don't matter.
    """
    active = F.col(status).eqNullSafe("active")
    links = settled(rows.where(active & F.col(parent).isNotNull()).select(key, parent), "links")
    front = rows.where(~active).select(key)
    cancelled = None
    for _ in range(passes):
        front = settled(links.join(front.select(F.col(key).alias(parent)), parent, "left_semi").select(key), "cancelled")
        if front.isEmpty():
            break
        cancelled = front if cancelled is None else cancelled.unionByName(front)
    if cancelled is None:
        return rows
    gone = rows.join(cancelled.distinct().withColumn("_gone", F.lit(True)), key, "left")
    return gone.withColumn(status, F.when(F.col("_gone"), "cancelled").otherwise(F.col(status))).select(*rows.columns)
