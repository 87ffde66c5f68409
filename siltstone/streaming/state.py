"""Keyed state over event streams. Each function here has a batch form over the same rows, and gives the same answer.

Events come in any order within the watermark's delay. A key's events wait in its state until the watermark is past
them, and are taken in order of time then, so how a stream is cut into batches, and where it is restarted, doesn't matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.operators.timeseries import keep_min_gap

#: A second in the unit of times here.
SECOND = 1_000_000


def counted_duplicates(events: DataFrame, keys: Sequence[str], ts: str, tie: str, window_s: int, late: str | None = None) -> DataFrame:
    """keys, kept_ts, kept_id, n_dropped: an event is dropped, and counted, if a kept one of its keys lies at most window_s before it.

    The window begins at the first kept event and isn't moved by those that are dropped. A stream (late: the watermark's
    delay) gives a row once its window is over. Events without a time are left out; null keys are keys; equal times go by the tie.
    """
    if late is None:
        return keep_min_gap(events, keys, ts, tie, window_s + 1 / SECOND)
    window, names = window_s * SECOND, list(keys)
    rows = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(*keys, F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(tie).cast("long").alias("_id"))
    out = T.StructType([*[rows.schema[k] for k in names], T.StructField("_t", T.LongType()), T.StructField("kept_id", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ids, at, id_, n = state.get if state.exists else ([], [], None, None, 0)
        waiting = list(zip(times, ids, strict=True))
        if not state.hasTimedOut:
            for pdf in pdfs:
                waiting += zip(pdf["_t"].tolist(), pdf["_id"].tolist(), strict=True)
        mark = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        done, over = 0, []
        for t, i in waiting:
            if t >= mark:
                break
            done += 1
            if at is None or t - at > window:
                if at is not None:
                    over.append((*key, at, id_, n))
                at, id_, n = t, i, 0
            else:
                n += 1
        waiting = waiting[done:]
        if at is not None and mark > at + window and (not waiting or waiting[0][0] > at + window):
            over.append((*key, at, id_, n))
            at, id_, n = None, None, 0
        if waiting or at is not None:
            state.update(([t for t, _ in waiting], [i for _, i in waiting], at, id_, n))
            wake = min([waiting[0][0]] if waiting else [at + window], default=at)
            state.setTimeoutTimestamp(max(wake, mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        if over:
            yield pd.DataFrame(over, columns=out.names)

    kept = rows.groupBy(*names).applyInPandasWithState(step, out, "times array<long>, ids array<long>, at long, id long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select(*names, F.timestamp_micros("_t").alias("kept_ts"), "kept_id", "n_dropped")


def _attempts(needed: Column, found: Column, tick: int, most: int) -> Column:
    """Ticks (multiples of tick) after needed and before found, at most `most`."""
    return F.least(F.lit(most), F.greatest(F.lit(0), F.floor((found - 1) / tick) - F.floor(needed / tick))).cast("int")


def late_actuals(events: DataFrame, keys: Sequence[str], ts: str, kind: str, value: str, tick_s: int = 3600, most: int = 24, late: str | None = None) -> DataFrame:
    """keys, outcome, needed_at, found_at, value, attempts: how the wait for each needed value ended.

    Events of kind need say that a value is missing, those of kind bar bring it; of several the first counts. Each
    tick (a multiple of tick_s since 1970) in between is an attempt to fetch the value. After `most` of them no more are made, which is
    a row with outcome gave_up; the value is still taken when it comes, as a row found. A batch table gives gave_up to
    all that were needed long enough before its last event; in a stream (late: the watermark's delay) the watermark
    takes that event's place. Values nobody needed give no rows; rows without a time or of another kind are left out.
    """
    names, tick = list(keys), tick_s * SECOND
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.where(F.col(ts).isNotNull() & F.col(kind).isin("need", "bar"))
    if late is None:
        rows = rows.select(*keys, t.alias("_t"), F.col(kind).alias("_k"), F.col(value).cast("double").alias("_v"))
        need, bar = (F.min(F.when(F.col("_k") == k, F.col("_t"))) for k in ("need", "bar"))
        first = F.min(F.when(F.col("_k") == "bar", F.struct("_t", "_v")))
        one = rows.groupBy(*keys).agg(need.alias("_need"), bar.alias("_bar"), first["_v"].alias("_v")).where("_need IS NOT NULL")
        last = F.broadcast(rows.agg(F.max("_t").alias("_last")))
        limit = (F.floor(F.col("_need") / tick) + most) * tick
        gave_up = F.when((limit < F.coalesce("_bar", F.col("_last") + 1)) & (limit < F.col("_last")), F.lit("gave_up"))
        outcomes = F.array_compact(F.array(gave_up, F.when(F.col("_bar").isNotNull(), F.lit("found"))))
        found = F.col("outcome") == "found"
        attempts = F.when(found, _attempts(F.col("_need"), F.col("_bar"), tick, most)).otherwise(F.lit(most))
        ended = one.crossJoin(last).withColumn("outcome", F.explode(outcomes))  # one row with the last time
        return ended.select(*keys, "outcome", F.timestamp_micros("_need").alias("needed_at"), F.when(found, F.timestamp_micros("_bar")).alias("found_at"), F.when(found, F.col("_v")).alias("value"), attempts.alias("attempts"))
    rows = rows.withWatermark(ts, late).select(*keys, F.col(ts), t.alias("_t"), F.col(kind).alias("_k"), F.col(value).cast("double").alias("_v"))
    kinds = [("outcome", T.StringType()), ("_need", T.LongType()), ("_bar", T.LongType()), ("value", T.DoubleType()), ("attempts", T.IntegerType())]
    out = T.StructType([*[rows.schema[k] for k in names], *[T.StructField(*f) for f in kinds]])

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        need, bar, v, told, ended = state.get if state.exists else (None, None, None, False, False)
        if ended:  # kept, so that what comes again is no new wait
            return
        if not state.hasTimedOut:
            for pdf in pdfs:
                for t, k, x in zip(pdf["_t"].tolist(), pdf["_k"].tolist(), pdf["_v"].tolist(), strict=True):
                    if k == "need":
                        need = t if need is None else min(need, t)
                    elif bar is None or (t, x) < (bar, v):
                        bar, v = t, x
        mark, over = state.getCurrentWatermarkMs() * 1000, []
        limit = None if need is None else (need // tick + most) * tick
        # nothing earlier can come once the watermark is past a time
        if limit is not None and not told and limit < mark and (bar is None or limit < bar):
            over.append((*key, "gave_up", need, None, None, most))
            told = True
        if need is not None and bar is not None and max(need, bar) < mark:
            over.append((*key, "found", need, bar, v, min(most, max(0, (bar - 1) // tick - need // tick))))
            ended = True
        state.update((need, bar, v, told, ended))
        ahead = [x for x in (need, bar, None if told else limit) if x is not None and x >= mark]
        if ahead and not ended:
            state.setTimeoutTimestamp(min(ahead) // 1000 + 1)
        if over:
            yield pd.DataFrame(over, columns=out.names).astype({"_need": "Int64", "_bar": "Int64", "attempts": "int32"})

    ended = rows.groupBy(*names).applyInPandasWithState(step, out, "need long, bar long, v double, told boolean, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return ended.select(*names, "outcome", F.timestamp_micros("_need").alias("needed_at"), F.timestamp_micros("_bar").alias("found_at"), "value", "attempts")


def debounced(requests: DataFrame, ts: str, keys: Sequence[str], quiet_s: int = 30, late: str | None = None) -> DataFrame:
    """keys, first_ts, fire_ts, n_requests: one run for each burst of requests, quiet_s after its last one.

    A request less than quiet_s after another puts the run off. A stream (late: the watermark's delay) gives the run once the watermark is past it.
    """
    if late:
        requests = requests.withWatermark(ts, late)
    burst = requests.groupBy(F.session_window(ts, f"{quiet_s} seconds").alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n_requests"))
    return burst.select(*keys, F.col("_w.start").alias("first_ts"), F.col("_w.end").alias("fire_ts"), "n_requests")
