"""Rows with a life: retention, snoozing, the review queue, forecasts from JSON, quarterly roll-up."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days that each class of rows is kept, and the limits of the review queue (fixed values).
RETENTION = {"accuracy": 365, "drift_acked": 90, "dismissed": 180, "error": 90}
RE_ELIGIBLE_DAYS, MIN_SEEN, CAP = 90, 2, 3


def swept(rows: DataFrame, kind: str, ts: str, now: Column, days: dict[str, int] | None = None) -> DataFrame:
    """rows without those older than their class may get; unlisted classes and rows without a time stay."""
    limit = F.coalesce(*[F.when(F.col(kind) == k, F.lit(n)) for k, n in (RETENTION if days is None else days).items()])
    old = F.col(ts).cast("timestamp") < now.cast("timestamp") - F.make_dt_interval(limit)
    return rows.where(~F.coalesce(old, F.lit(False)))


def disposed(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """rows (key, status, ...) with the status that a decision (key, decision) gives: acted or dismissed. Only open and snoozed rows change."""
    met = rows.join(decisions.select(key, "decision"), key, "left")
    new = F.when(F.col("decision") == "dismissed", "dismissed").when(F.col("decision").isin("acted_as_prescribed", "acted_modified", "skipped"), "acted")
    status = F.when(F.col("status").isin("open", "snoozed"), F.coalesce(new, F.col("status"))).otherwise(F.col("status"))
    return met.withColumn("status", status).select(*rows.columns)


def recommendation_state(rows: DataFrame, now: Column, max_snoozes: int = 2, aging_days: int = 14) -> DataFrame:
    """rows (created_at, status, snoozed_until, snooze_count) with age_days, auto_revived, forced_decision, aging."""
    seconds = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.coalesce(F.col("created_at").cast("timestamp"), now.cast("timestamp")))
    age = F.greatest(F.floor(seconds / 86400), F.lit(0)).cast("int")
    revived = (F.col("status") == "snoozed") & (F.col("snoozed_until").cast("timestamp") < now.cast("timestamp"))
    rows = rows.withColumns({"age_days": age, "auto_revived": F.coalesce(revived, F.lit(False))})
    return rows.withColumns({"forced_decision": F.coalesce("snooze_count", F.lit(0)) >= max_snoozes, "aging": F.col("age_days") > aging_days})


def _bump(state: dict | None, key, r) -> dict | None:
    """The queue row of a key after one sighting or dismissal."""
    if r.action == "dismissed":
        if state:
            state["status"], state["resolved_at"] = "dismissed", r.ts
        return state
    if state is None:
        state = {"ticker": key, "first_seen": r.ts, "times_seen": 0, "channels": [], "status": "pending", "resolved_at": None}
    if state["status"] == "dismissed" and (r.ts - state["resolved_at"]).days >= RE_ELIGIBLE_DAYS:
        state["status"], state["resolved_at"] = "pending", None
    state["times_seen"] += 1
    state["last_seen"] = r.ts
    if r.channel and r.channel not in state["channels"]:
        state["channels"] = [*state["channels"], r.channel][-CAP:]
    return state


def _folder(batches):
    """A row for each key of a partition sorted by key: the state is carried along, so no group is held in memory."""
    key, state = None, None
    for pdf in batches:
        done = []
        for r in pdf.itertuples(index=False):
            if r.ticker != key:
                if state:
                    done.append(state)
                key, state = r.ticker, None
            state = _bump(state, key, r)
        if done:
            yield pd.DataFrame(done)
    if state:
        yield pd.DataFrame([state])


def review_queue(sightings: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """ticker, first_seen, last_seen, times_seen, channels, status, resolved_at, shown of each ticker that was seen.

    sightings: ticker, ts, action (seen, dismissed), channel. Tickers are trimmed and in upper case; empty ones and
    rows without a time are left out. channels holds the last three that weren't there. A dismissed ticker comes
    back when it is seen 90 days later; shown: pending and seen twice. The fold reads each ticker's rows in order
    of time, then `order`, as a sorted stream.
    """
    rows = sightings.withColumn("ticker", F.upper(F.trim("ticker"))).where((F.length("ticker") > 0) & F.col("ts").isNotNull())
    keep = list(dict.fromkeys(["ticker", "ts", "action", "channel", *order]))
    sorted_ = rows.select(*keep).repartition("ticker").sortWithinPartitions("ticker", "ts", "action", *order)
    schema = "ticker string, first_seen timestamp, last_seen timestamp, times_seen long, channels array<string>, status string, resolved_at timestamp"
    folded = sorted_.mapInPandas(_folder, schema)
    return folded.withColumn("shown", (F.col("status") == "pending") & (F.col("times_seen") >= MIN_SEEN))


def exploded_forecasts(tasks: DataFrame, key: str, result: str, known: DataFrame | None = None) -> DataFrame:
    """key, horizon (from 1), ts, close of each bar in a JSON result {"forecast": [...]}; without the (key, horizon) of known. Broken JSON gives none."""
    bars = F.from_json(result, "forecast array<struct<ts: string, close: double>>")["forecast"]
    rows = tasks.select(key, F.posexplode(bars).alias("_at", "_bar")).select(key, (F.col("_at") + 1).alias("horizon"), "_bar.ts", "_bar.close")
    return rows if known is None else rows.join(known.select(key, "horizon"), [key, "horizon"], "left_anti")


def oldest_quarter(snapshots: DataFrame, day: str, keep: int = 13) -> DataFrame:
    """snapshots with quarter (like 2024-Q1) and rolled: whether a row belongs to the oldest quarter while more than `keep` days are held."""
    stats = snapshots.agg(F.count_distinct(day).alias("_n"), F.min(day).alias("_first"))
    start = F.date_trunc("quarter", F.col(day))
    label = F.concat(F.year(day), F.lit("-Q"), F.quarter(day))
    rolled = F.coalesce((F.col("_n") > keep) & (start == F.date_trunc("quarter", F.col("_first"))), F.lit(False))
    return snapshots.join(F.broadcast(stats)).withColumns({"quarter": label, "rolled": rolled}).drop("_n", "_first")
