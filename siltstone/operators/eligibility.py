"""Which models may answer a request: the first reason why not, and what the answer would use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reasons in the order in which they are looked for (fixed values).
REASONS = ("UNKNOWN_MODEL", "UNSUPPORTED_INTERVAL", "UNSUPPORTED_ASSET", "MISSING_FEATURES", "INSUFFICIENT_HISTORY", "HORIZON_OUT_OF_RANGE")


def eligibility(requests: DataFrame, models: DataFrame) -> DataFrame:
    """requests with reason (null if the model may answer), missing (features) and horizon (null unless it may).

    requests: model_id, asset_class, interval, bars, features, horizon (null: the model's default). models (one row an id): id, intervals,
    asset_classes, required, min_bars, default_horizon, max_horizon. Features are compared in any case; missing has
    the model's spelling, in its order. A request without a model's id names an unknown one; null bars are 0, null lists empty.
    """
    names = ("intervals", "asset_classes", "required", "min_bars", "default_horizon", "max_horizon")
    own = models.select(F.col("id").alias("model_id"), *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_known"))
    both = requests.join(own, "model_id", "left")
    none = F.array().cast("array<string>")
    have = F.transform(F.coalesce("features", none), lambda x: F.lower(x))
    both = both.withColumn("_have", have)
    both = both.withColumn("missing", F.filter(F.coalesce("_required", none), lambda x: ~F.coalesce(F.array_contains(F.col("_have"), F.lower(x)), F.lit(False))))
    horizon = F.coalesce("horizon", "_default_horizon")
    failing = (
        F.col("_known").isNull(),
        ~F.coalesce(F.array_contains("_intervals", F.col("interval")), F.lit(False)),
        ~F.coalesce(F.array_contains("_asset_classes", F.col("asset_class")), F.lit(False)),
        F.size("missing") > 0,
        F.coalesce("bars", F.lit(0)) < F.col("_min_bars"),
        ~F.coalesce(horizon.between(1, F.col("_max_horizon")), F.lit(False)),
    )
    reason = F.coalesce(*[F.when(f, F.lit(r)) for f, r in zip(failing, REASONS, strict=True)])
    out = both.withColumn("reason", reason).withColumn("_horizon", F.when(reason.isNull(), horizon))
    return out.select(*[c for c in requests.columns if c != "horizon"], "reason", F.when(F.col("reason") == "MISSING_FEATURES", F.col("missing")).alias("missing"), F.col("_horizon").alias("horizon"))


def eligible_models(combinations: DataFrame, models: DataFrame) -> DataFrame:
    """combinations (asset_class, interval, bars; null bars: any history) with id of each model that supports them."""
    lists = models.select("id", F.explode("asset_classes").alias("asset_class"), "intervals", "min_bars").distinct()
    lists = lists.select("id", "asset_class", F.explode("intervals").alias("interval"), "min_bars").distinct()
    return combinations.join(lists, ["asset_class", "interval"]).where(F.col("bars").isNull() | (F.col("bars") >= F.col("min_bars"))).drop("min_bars")
