"""Forecast accuracy: row metrics, evaluation of what is pending, grids, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.timeseries import latest_n


def row_metrics(predicted: Column, actual: Column, baseline: Column) -> dict[str, Column]:
    """error_pct, abs_error_pct, sq_error and direction_ok. Null for an actual of 0 or less; direction is null without a positive baseline."""
    fair = actual > 0
    error = F.when(fair, (actual - predicted) / actual)
    moved, meant = F.signum(actual - baseline), F.signum(predicted - baseline)
    return {
        "error_pct": error,
        "abs_error_pct": F.abs(error),
        "sq_error": F.when(fair, (actual - predicted) * (actual - predicted)),
        "direction_ok": F.when(fair & (baseline > 0), moved == meant),
    }


def evaluate_pending(predictions: DataFrame, actuals: DataFrame, evaluated: DataFrame, key: str, on: Sequence[str]) -> DataFrame:
    """Predictions that aren't evaluated yet and have an actual, with the actual's columns. Running it again adds nothing."""
    return predictions.join(evaluated.select(key), key, "left_anti").join(actuals, list(on))


def accuracy_grid(rows: DataFrame, keys: Sequence[str], newest: Sequence[Column], last_n: int = 30) -> DataFrame:
    """keys, n, mape, rmse, hit_rate over the newest last_n rows of each group; rows without an error don't count."""
    kept = latest_n(rows.where(F.col("error_pct").isNotNull()), keys, newest, last_n)
    return kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("abs_error_pct").alias("mape"),
        F.sqrt(F.avg("sq_error")).alias("rmse"),
        F.avg(F.col("direction_ok").cast("int")).alias("hit_rate"),
    )


def drift(rows: DataFrame, keys: Sequence[str], ts: str, error: str, since: Column, min_all: int = 30, min_recent: int = 10, ratio: float = 1.5, open_alerts: DataFrame | None = None) -> DataFrame:
    """Groups whose recent mean error is `ratio` times that of all rows or more, without those that have an open alert."""
    recent = F.when(F.col(ts) >= since, F.col(error))
    g = rows.groupBy(*keys).agg(F.count(error).alias("n_all"), F.count(recent).alias("n_recent"), F.avg(error).alias("mean_all"), F.avg(recent).alias("mean_recent"))
    found = g.where((F.col("n_all") >= min_all) & (F.col("n_recent") >= min_recent) & (F.col("mean_all") > 0) & (F.col("mean_recent") / F.col("mean_all") >= ratio))
    return found if open_alerts is None else found.join(open_alerts.select(*keys), list(keys), "left_anti")


def horizon_grid(tickers: DataFrame, key: str, horizons: Sequence[int], predictions: DataFrame, actuals: DataFrame, anchor: Column, mode: str) -> DataFrame:
    """key, horizon, day, predicted, actual for each key and horizon (a stated list).

    mode "target": the anchor is the target day, and the prediction was made `horizon` days before; mode "anchor": it
    was made on the anchor day, for `horizon` days after. predictions: key, day, predicted, made_at (the newest
    wins); actuals: key, day, actual. Missing ones are null.
    """
    grid = tickers.select(key, F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    made = F.date_sub(anchor, F.col("horizon")) if mode == "target" else anchor
    target = anchor if mode == "target" else F.date_add(anchor, F.col("horizon"))
    grid = grid.withColumns({"day": made, "target_day": target})
    newest = predictions.groupBy(key, "day").agg(F.max_by("predicted", "made_at").alias("predicted"))
    real = actuals.select(key, F.col("day").alias("target_day"), "actual")
    return grid.join(newest, [key, "day"], "left").join(real, [key, "target_day"], "left").select(key, "horizon", "day", "target_day", "predicted", "actual")
