"""Series operators: latest rows, as-of joins, gap filling, trailing windows and cross-sections.

All take and return DataFrames. Windows are partitioned by the series' keys; last_so_far(), in_blocks(), numbered() and
keep_min_gap() also deal a single series out by ranges or blocks of its rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.shared import settled


def latest_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """old and new together, one row for each key: the one with the greatest version columns."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_best"))
    return best.select(*keys, "_best.*").select(*both.columns)


def latest_in_day(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """keys, day, last_value: the last value of each day."""
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.max_by(value, F.col(ts)).alias("last_value"))


def last_so_far(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """df with out: the last value that isn't null among the rows of its group up to it, by the columns of order, however large a group is.

    Rows are dealt by ranges of keys and order, and looked at within a range. What a range begins with is the end of those before it: of
    the last values of two neighbouring ranges the later one counts if it is of the same group and not null, so one value
    for each range is all that has to be passed on.
    """
    spark = df.sparkSession
    rows = df.withColumn("_v", value).withColumn("_k", F.to_json(F.struct(*keys)))
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, *order)
    own = settled(dealt.withColumn("_p", F.spark_partition_id()), "ranges")
    place = F.struct(*keys, *order)
    known = F.max_by(F.struct("_k", "_v"), F.when(F.col("_v").isNotNull(), place))
    ends = own.groupBy("_p").agg(F.min_by("_k", place).alias("first"), F.max_by("_k", place).alias("last"), known.alias("known"))
    added, key, held = [], None, None
    for r in sorted(ends.collect(), key=lambda r: r["_p"]):
        before = held if r["first"] == key else None
        if before is not None:
            added.append((r["_p"], r["first"], before))
        key = r["last"]
        if r["known"] is not None and r["known"]["_k"] == key:
            held = r["known"]["_v"]
        elif r["first"] != key:
            held = None
        else:
            held = before
    schema = T.StructType([T.StructField("_p", T.IntegerType()), T.StructField("_k", T.StringType()), T.StructField("_before", own.schema["_v"].dataType)])
    more = F.broadcast(spark.createDataFrame(added, schema))  # one row for each range at most
    w = Window.partitionBy("_p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = own.withColumn(out, F.last("_v", ignorenulls=True).over(w)).join(more, ["_p", "_k"], "left")
    return seen.withColumn(out, F.coalesce(out, "_before")).select(*df.columns, out)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, value: str, tolerance_s: int) -> DataFrame:
    """left with right_ts and right_value: the newest right row of the keys at or before ts, tolerance_s seconds at most.

    Left rows without one are dropped, null keys meet nothing; a right value of 0 counts, of rows at one time the greatest. The distance is that of
    the times to the microsecond. Both sides are put in one order, and dealt by ranges of it (see last_so_far()), so
    a key may hold any share of the rows.
    """
    names, known = left.columns, F.lit(True)
    for c in keys:
        known = known & F.col(c).isNotNull()
    left, right = left.where(known), right.where(known)
    l_rows = left.select(*names, F.lit(None).cast(right.schema[ts].dataType).alias("_rts"), F.lit(None).cast(right.schema[value].dataType).alias("_rval"), F.lit(1).alias("_side"))
    r_rows = right.select(
        *[F.col(c) if c in keys or c == ts else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names],
        F.col(ts).alias("_rts"), F.col(value).alias("_rval"), F.lit(0).alias("_side"),
    )
    seen = last_so_far(l_rows.unionByName(r_rows), keys, [ts, "_side", "_rval"], F.when(F.col("_side") == 0, F.struct("_rts", "_rval")), "_hit")
    near = F.col(ts) - F.col("_hit._rts") <= F.make_dt_interval(secs=F.lit(tolerance_s))
    hit = seen.where((F.col("_side") == 1) & F.col("_hit").isNotNull() & near)
    return hit.select(*names, F.col("_hit._rts").alias("right_ts"), F.col("_hit._rval").alias("right_value"))


def ratio(numerator: DataFrame, denominator: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """on, ratio: values at equal keys divided; zero denominators are left out."""
    d = denominator.select(*on, F.col(value).alias("_d")).where(F.col("_d") != 0)
    return numerator.select(*on, F.col(value).alias("_n")).join(d, list(on)).select(*on, (F.col("_n") / F.col("_d")).alias("ratio"))


def gapfill_daily(df: DataFrame, day: str, first: str, last: str, values: dict[str, Column]) -> DataFrame:
    """A row for each day from first to last with the aggregates of values, 0 where there are none."""
    spark = df.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(day))
    per_day = df.groupBy(day).agg(*[c.alias(k) for k, c in values.items()])
    return days.join(per_day, day, "left").na.fill(0, list(values))


def trailing_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int) -> DataFrame:
    """df with sma: the mean of the last n values, null while there are fewer."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, 0)
    full = F.count(F.lit(1)).over(w) == n
    return df.withColumn("sma", F.when(full, F.avg(value).over(w)))


def below_mean_streak(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int, days: int) -> DataFrame:
    """keys, n_points, fired: whether the last `days` values all lie below their trailing mean of n; too few points don't fire."""
    rows = trailing_mean(df, keys, order, value, n)
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    rows = rows.withColumn("_back", F.row_number().over(last))
    below = F.count_if((F.col("_back") <= days) & (F.col(value) < F.col("sma")))
    n_points = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(n_points.alias("n_points"), ((below == days) & (n_points >= n + days)).alias("fired"))


def threshold_streak(df: DataFrame, keys: Sequence[str], order: str, value: str, limit: float, k: int, above: bool = True) -> DataFrame:
    """keys, fired: whether the last k values all lie strictly above (below) the limit, k of them being there."""
    last = latest_n(df, keys, [F.desc(order)], k)
    past = F.col(value) > limit if above else F.col(value) < limit
    return last.groupBy(*keys).agg((F.count_if(past) == k).alias("fired"))


def change_pct(df: DataFrame, keys: Sequence[str], order: str, value: str, threshold: float) -> DataFrame:
    """keys, pct, fired: change from the first to the last value, as a share of the first; up by threshold or, if that is negative, down by it. First 0: null, not fired."""
    ends = df.groupBy(*keys).agg(F.min_by(value, order).alias("a"), F.max_by(value, order).alias("b"))
    pct = F.when(F.col("a") != 0, (F.col("b") - F.col("a")) / F.col("a") * 100)
    fired = pct >= threshold if threshold >= 0 else pct <= threshold
    return ends.select(*keys, pct.alias("pct"), F.coalesce(fired, F.lit(False)).alias("fired"))


def relative_strength(df: DataFrame, keys: Sequence[str], order: str, value: str, base: int = 252, step: int = 14, dead: float = 0.005) -> DataFrame:
    """df with rs (100 times the value over the one base rows back), momentum (over step rows back, less 1) and direction."""
    w = Window.partitionBy(*keys).orderBy(order)
    old, near = F.lag(value, base).over(w), F.lag(value, step).over(w)
    momentum = F.when(near != 0, F.col(value) / near - 1)
    direction = F.when(momentum > dead, "up").when(momentum < -dead, "down").when(momentum.isNotNull(), "flat")
    return df.withColumns({"rs": F.when(old != 0, 100 * F.col(value) / old), "momentum": momentum, "direction": direction})


def zscore(df: DataFrame, keys: Sequence[str], order: str, value: str, window: int = 126) -> DataFrame:
    """df with z: distance from the trailing mean in population deviations; 0 for the first `window` rows and for no deviation."""
    w = Window.partitionBy(*keys).orderBy(order)
    trailing = w.rowsBetween(1 - window, 0)
    sd = F.stddev_pop(value).over(trailing)
    ready = (F.row_number().over(w) > window) & (sd > 0)
    return df.withColumn("z", F.when(ready, (F.col(value) - F.avg(value).over(trailing)) / sd).otherwise(F.lit(0.0)))


def rank_across(df: DataFrame, at: Sequence[str], value: str, tie: str, name: str = "rank") -> DataFrame:
    """df with the place of each row among those of the same `at`, the greatest value first; null values have none."""
    w = Window.partitionBy(*at, F.col(value).isNull()).orderBy(F.desc(value), tie)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.row_number().over(w)))


def log_returns(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """df with ret: the log of the value over the one before; 0 where either isn't positive, null in the first row."""
    w = Window.partitionBy(*keys).orderBy(order)
    old = F.lag(value).over(w)
    return df.withColumn("ret", F.when(old.isNull(), None).when((old > 0) & (F.col(value) > 0), F.ln(F.col(value) / old)).otherwise(0.0))


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], window: int, block: int = 50_000) -> tuple[DataFrame, Window]:
    """df dealt into blocks of rows in order, and the frame of a row's last `window` rows in it; a series of any length is spread over blocks.

    Each block begins with the window - 1 rows before it, for which _ahead is true: they are there to be looked back at, and are to be left out then.
    """
    size = max(block, 2 * window)
    rows = numbered(df, keys, order, "_n")
    own = F.floor((F.col("_n") - 1) / size)
    late = (F.col("_n") - 1) % size >= size - (window - 1)
    at = F.explode(F.when(late, F.array(F.struct(own.alias("b"), F.lit(False).alias("a")), F.struct((own + 1).alias("b"), F.lit(True).alias("a")))).otherwise(F.array(F.struct(own.alias("b"), F.lit(False).alias("a")))))
    dealt = rows.withColumn("_at", at).withColumns({"_block": F.col("_at.b"), "_ahead": F.col("_at.a")}).drop("_at")
    return dealt, Window.partitionBy("_block", *keys).orderBy("_n")


def _corr(a: str, b: str, w: Window) -> Column:
    """The correlation of two columns over a frame; 0 where one of them doesn't vary there."""
    return F.coalesce(F.try_divide(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)), F.lit(0.0))


def rolling_correlation(a: DataFrame, b: DataFrame, order: str, value: str, window: int = 90, block: int = 50_000) -> DataFrame:
    """order, corr of the two series' returns over the last `window` common rows; null until there are that many, 0 if undefined.

    The pair is one series, which goes in blocks of rows (see in_blocks()).
    """
    pair = a.select(order, F.col(value).alias("_a")).join(b.select(order, F.col(value).alias("_b")), order).withColumn("_pair", F.lit(0))
    rows, w = in_blocks(pair, ["_pair"], [F.col(order)], window, block)
    last = w.rowsBetween(1 - window, 0)
    full = F.count(F.lit(1)).over(last) == window
    return rows.withColumn("corr", F.when(full, _corr("_a", "_b", last))).where("NOT _ahead").select(order, "corr")


def aligned_correlation(a: DataFrame, b: DataFrame, order: str, value: str, window: int = 90, block: int = 50_000) -> DataFrame:
    """order, corr of the log returns of two series of values, taken between the times that both have.

    A step with a value that isn't positive is left out. Null until there are `window` returns, 0 if undefined.
    """
    pair = a.select(order, F.col(value).alias("_x")).join(b.select(order, F.col(value).alias("_y")), order).withColumn("_pair", F.lit(0))
    rows, w = in_blocks(pair, ["_pair"], [F.col(order)], 2, block)
    sound = (F.col("_x") > 0) & (F.col("_y") > 0) & (F.lag("_x").over(w) > 0) & (F.lag("_y").over(w) > 0)
    steps = rows.select(order, "_pair", "_ahead", *[F.when(sound, F.ln(F.try_divide(F.col(c), F.lag(c).over(w)))).alias(r) for c, r in (("_x", "_a"), ("_y", "_b"))])
    steps = steps.where("NOT _ahead AND _a IS NOT NULL").drop("_ahead")
    rows, w = in_blocks(steps, ["_pair"], [F.col(order)], window, block)
    last = w.rowsBetween(1 - window, 0)
    corr = F.when(F.count(F.lit(1)).over(last) == window, _corr("_a", "_b", last))
    return rows.withColumn("corr", corr).where("NOT _ahead").select(order, "corr")


def correlation_matrix(df: DataFrame, key: str, order: str, value: str, window: int = 90) -> DataFrame:
    """a, b, corr for each pair of series, over the last `window` rows of each, matched by order."""
    last = latest_n(df, [key], [F.desc(order)], window)
    x = last.select(F.col(key).alias("a"), F.col(order).alias("_o"), F.col(value).alias("_x"))
    y = last.select(F.col(key).alias("b"), F.col(order).alias("_o"), F.col(value).alias("_y"))
    corr = F.coalesce(F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y")), F.lit(0.0))
    return x.join(y, "_o").groupBy("a", "b").agg(corr.alias("_c")).select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("_c")).alias("corr"))


def every_kth_back(df: DataFrame, keys: Sequence[str], order: str, k: int, periods: int) -> DataFrame:
    """Each series' last row and every kth before it, `periods` of them, with back (0: the last)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    rows = df.withColumn("_back", F.row_number().over(w) - 1)
    return rows.where((F.col("_back") % k == 0) & (F.col("_back") < k * periods)).withColumn("back", (F.col("_back") / k).cast("int")).drop("_back")


def cycle_phase(df: DataFrame, keys: Sequence[str], order: str, spread: str, window: int = 252, dead: float = 0.1, wide: float = 1.0) -> DataFrame:
    """keys, spread, trend, was_inverted, phase of each spread series' end.

    Inverted now: late. Rising after an inversion in the window: recession. Rising and above `wide`: early. Otherwise mid.
    A change of less than `dead` isn't a trend.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    last = df.withColumn("_back", F.row_number().over(w) - 1).where(F.col("_back") <= window)
    ends = last.groupBy(*keys).agg(
        F.min_by(spread, "_back").alias("spread"), F.max_by(spread, "_back").alias("_first"), F.bool_or(F.col(spread) <= 0).alias("was_inverted")
    )
    delta = F.col("spread") - F.col("_first")
    trend = F.when(F.abs(delta) < dead, "flat").when(delta > 0, "rising").otherwise("falling")
    phase = (
        F.when(F.col("spread") <= 0, "late")
        .when(F.col("was_inverted") & (trend == "rising"), "recession")
        .when((F.col("spread") > wide) & (trend == "rising"), "early")
        .otherwise("mid")
    )
    return ends.select(*keys, "spread", trend.alias("trend"), "was_inverted", phase.alias("phase"))


def collapse_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before in their group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_old", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_old")) | F.col("_old").isNull()).drop("_old")


def _numberer(batches):
    """Adds _n, the number of each row among those of its _k in the partition, _p, the partition, and _i, the place in it."""
    part, at, key, n = TaskContext.get().partitionId(), 0, None, 0
    for b in batches:
        if not b.num_rows:
            continue
        keys = b["_k"].to_pylist()
        numbers = []
        for k in keys:
            n = n + 1 if k == key else 1
            key = k
            numbers.append(n)
        new = [pa.array(numbers, pa.int64()), pa.array([part] * b.num_rows, pa.int32()), pa.array(range(at, at + b.num_rows), pa.int64())]
        at += b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "_n", "_p", "_i"])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], place: str) -> DataFrame:
    """df with place, the row's number (from 1) in its group by order, however large a group is.

    The rows are dealt by ranges of keys and order (those that are equal in all of it go together) and numbered within a range; only the first group of a range
    can have begun in an earlier one, so what has to be added is one number for each range.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_k", F.to_json(F.struct(*keys)))
    dealt = rows.repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*rows.schema, T.StructField("_n", T.LongType()), T.StructField("_p", T.IntegerType()), T.StructField("_i", T.LongType())])
    own = settled(dealt.mapInArrow(_numberer, schema), "numbered")
    ends = own.groupBy("_p").agg(F.min_by("_k", "_i").alias("first"), F.max_by("_k", "_i").alias("last"), F.max_by("_n", "_i").alias("n"))
    added, key, n = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["_p"]):
        before = n if r["first"] == key else 0
        if before:
            added.append((r["_p"], r["first"], before))
        key, n = r["last"], r["n"] + (before if r["last"] == r["first"] else 0)
    more = F.broadcast(spark.createDataFrame(added, "_p int, _k string, _more long"))
    out = own.join(more, ["_p", "_k"], "left").withColumn(place, F.col("_n") + F.coalesce("_more", F.lit(0)))
    return out.select(*df.columns, place)


def _exits(t: np.ndarray, gap: int) -> list[list[int]]:
    """[limit, row]: after a last kept time of limit - gap or earlier (from the limit before on), row is the last that is kept of rows t."""
    following, last = np.searchsorted(t, t + gap), np.arange(len(t))
    for i in range(len(t) - 1, -1, -1):
        if following[i] < len(t):
            last[i] = last[following[i]]
    out: list[list[int]] = []
    for i in np.unique(t, return_index=True)[1].tolist():
        if out and out[-1][1] == last[i]:
            out[-1][0] = int(t[i])
        else:
            out.append([int(t[i]), int(last[i])])
        if t[i] >= t[0] + gap:
            break
    return out


def _gap_folder(names: list[str], gap: int, schema: pa.Schema):
    """Kept rows of a range with their counts; its head, rows without a count, up to the first row that is kept for sure; info.

    A row is kept for sure if it begins a key or lies gap or more after the row before. What was kept before the
    head isn't known here; info (one row) says what the range ends with: a kept row, or one that hangs on that.
    """

    def run(batches):
        part, first, key, before, kept, head = TaskContext.get().partitionId(), None, None, None, None, []
        for b in batches:
            out = []
            for k, t, id_, *own in zip(*(b[c].to_pylist() for c in ["_k", "_t", "_id", *names]), strict=True):
                if first is None:
                    first = key = k
                if kept is None and k == key and (before is None or t - before < gap):
                    head.append((t, id_))
                    out.append((*own, t, id_, None, part, None))
                elif kept is None or k != key or t - kept[-3] >= gap:
                    if kept:
                        out.append((*kept[:-1], kept[-1], part, None))
                    kept = [*own, t, id_, 0]
                else:
                    kept[-1] += 1
                key, before = k, t
            yield _batch(out, schema)
        if first is not None:
            info = {"first": first, "last": key, "out": kept and kept[-3:-1]}
            if kept is None:
                info["map"] = [[limit, *head[i]] for limit, i in _exits(np.array([t for t, _ in head]), gap)]
            out = [(*kept, part, None)] if kept else []
            yield _batch([*out, (*[None] * len(names), None, None, None, part, json.dumps(info))], schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


def keep_min_gap(df: DataFrame, keys: Sequence[str], ts: str, tie: str, gap_s: float) -> DataFrame:
    """keys, kept_ts, kept_id, n_dropped: rows at least gap_s after the last kept row of their group, and how many later ones each swallows.

    Whether a row is kept depends on the last kept one, so each group is folded in order, as a sorted stream that is
    dealt by ranges of keys and time. What a range starts from comes from the ends of the ranges before it. Rows
    without a time are left out.
    """
    gap, spark = int(gap_s * 1_000_000), df.sparkSession
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(*keys, t.alias("_t"), F.col(tie).cast("long").alias("_id")).where("_t is not null").withColumn("_k", F.to_json(F.struct(*keys)))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *keys, "_t", "_id").sortWithinPartitions(*keys, "_t", "_id")
    fields = [*[T.StructField(k, rows.schema[k].dataType) for k in keys], *[T.StructField(c, T.LongType()) for c in ("_t", "_id", "n")]]
    schema = T.StructType([*fields, T.StructField("_p", T.IntegerType()), T.StructField("_info", T.StringType())])
    folded = settled(dealt.mapInArrow(_gap_folder(list(keys), gap, to_arrow_schema(schema)), schema), "gaps")
    starts, last, kept = {}, None, None
    for r in sorted(folded.where("_info is not null").select("_p", "_info").collect(), key=lambda r: r["_p"]):
        info = json.loads(r["_info"])
        start = kept if info["first"] == last else None
        if start:
            starts[r["_p"]] = start
        if info["out"]:
            kept = info["out"]
        else:  # all of the range is head: the first kept row is the first at least a gap after the start
            limit = start[0] + gap if start else None
            kept = info["map"][0][1:] if start is None else next((m[1:] for m in info["map"] if limit <= m[0]), start)
        last = info["last"]
    names = [*keys, "_t", "_id", "n"]

    def heads(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", "_id"], ignore_index=True)
        at, id_ = starts.get(int(pdf["_p"].iloc[0]), (None, None))
        out, n = [], 0
        for t, i in zip(pdf["_t"].tolist(), pdf["_id"].tolist(), strict=True):
            if at is None or t - at >= gap:
                if at is not None:
                    out.append((at, id_, n))
                at, id_, n = t, i, 0
            else:
                n += 1
        out.append((at, id_, n))
        own = pdf.iloc[[0] * len(out)][list(keys)].reset_index(drop=True)
        return own.assign(_t=[x[0] for x in out], _id=[x[1] for x in out], n=[x[2] for x in out])[names]

    sure = folded.where("n is not null").select(*names)
    own = folded.where("n is null and _info is null").groupBy("_p").applyInPandas(heads, T.StructType(fields))
    every = sure.unionByName(own).groupBy(*keys, "_t", "_id").agg(F.sum("n").alias("n"))
    return every.select(*keys, F.timestamp_micros("_t").alias("kept_ts"), F.col("_id").alias("kept_id"), F.col("n").alias("n_dropped"))


def budget_cap(df: DataFrame, keys: Sequence[str], score: str, order: Sequence[str], k: int) -> DataFrame:
    """The k rows with the greatest scores of each group, with place: their number in time order."""
    top = latest_n(df, keys, [F.desc(score), *[F.col(c) for c in order]], k)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def future_timestamps(last: DataFrame, ts: str, seconds: int, n: int) -> DataFrame:
    """Each row of last n times, with step (from 1) and future_ts: ts and step times the interval."""
    rows = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    micros = F.unix_micros(F.col(ts).cast("timestamp")) + F.col("step") * F.lit(seconds * 1_000_000)
    return rows.withColumn("future_ts", F.timestamp_micros(micros))
