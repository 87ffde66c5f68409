"""Bundles of evidence under a budget of tokens, and whether the tickers of a question have context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a word, excerpts that are always kept, characters that a text is halved down to, and steps in all (fixed values).
PER_WORD, KEPT, SHORTEST, STEPS = 1.3, 3, 50, 200


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def _halved(cap: int):
    """A bundle's last excerpts, at most KEPT of them, with the longest one halved again and again."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "at"], ascending=[False, True], na_position="last", kind="stable")
        texts = [t or "" for t in pdf["text"]]
        # the first of equally long ones counts, in order of score
        other, steps = int(pdf["_other"].iloc[0]), int(pdf["_steps"].iloc[0])
        for _ in range(steps):
            if int((other + sum(len(t.split()) for t in texts)) * PER_WORD) <= cap:
                break
            at = max(range(len(texts)), key=lambda i: len(texts[i]))
            if len(texts[at]) <= SHORTEST:
                break
            texts[at] = texts[at][: max(SHORTEST, len(texts[at]) // 2)]
        return pdf.assign(text=texts)[["bundle", "kind", "card", "at", "score", "text"]]

    return run


def truncated(items: DataFrame, cap: int) -> DataFrame:
    """The items (bundle, kind, card, at, score, text) that stay so that a bundle has `cap` tokens at most, as far as that goes.

    First go evaluations (kind evaluation): of the first card with several the oldest (they stand newest first, by at), then those of the next cards;
    one of each card stays. Then excerpts (kind evidence) go, the lowest scores first and of equal ones the first by at, until three are
    left; then the longest of these is halved, down to 50 characters, again and again. Other kinds stay. A bundle takes 200 steps
    at most, so whatever its size only its first 200 candidates are ranked. Tokens are words times 1.3, rounded down. Null scores
    are the lowest, null texts empty; items without a bundle stay as they are.
    """
    rows = items.select("bundle", "kind", "card", "at", "score", "text").withColumn("_w", _words(F.col("text")))
    own = rows.where("bundle IS NOT NULL")
    total = own.groupBy("bundle").agg(F.sum("_w").alias("_total"))
    over = total.where(F.floor(F.col("_total") * PER_WORD) > cap)
    # per card only one row stays for sure; per bundle only three excerpts
    newest = own.where("kind = 'evaluation'").groupBy("bundle", "card").agg(F.min("at").alias("at"))
    evaluations = own.where("kind = 'evaluation'").join(newest.withColumn("_stays", F.lit(True)), ["bundle", "card", "at"], "left").where("_stays IS NULL").drop("_stays")
    last = Window.partitionBy("bundle").orderBy(F.desc_nulls_last("score"), F.desc("at"))
    kept = own.where("kind = 'evidence'").withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= KEPT).select("bundle", "at", F.lit(True).alias("_stays"))
    excerpts = own.where("kind = 'evidence'").join(kept, ["bundle", "at"], "left").where("_stays IS NULL").drop("_stays")
    order = F.struct(
        (F.col("kind") == "evidence").alias("a"),
        F.when(F.col("kind") == "evaluation", F.col("card").cast("double")).otherwise(F.coalesce("score", F.lit(float("-inf")))).alias("b"),
        F.when(F.col("kind") == "evaluation", -F.col("at")).otherwise(F.col("at")).alias("c"),
    )
    candidates = evaluations.unionByName(excerpts).join(over, "bundle").withColumn("_o", order)
    ranked = candidates.withColumn("_n", F.row_number().over(Window.partitionBy("bundle").orderBy("_o"))).where(F.col("_n") <= STEPS)
    before = F.coalesce(F.sum("_w").over(Window.partitionBy("bundle").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gone = ranked.withColumn("_gone", before).where(F.floor((F.col("_total") - F.col("_gone")) * PER_WORD) > cap).select("bundle", "kind", "card", "at", "_w", "_n")
    after = gone.groupBy("bundle").agg(F.sum("_w").alias("_less"), F.count(F.lit(1)).alias("_used"))
    rest = over.join(after, "bundle", "left").select("bundle", (F.col("_total") - F.coalesce("_less", F.lit(0))).alias("_left"), (F.lit(STEPS) - F.coalesce("_used", F.lit(0))).alias("_steps"))
    still = rest.where((F.floor(F.col("_left") * PER_WORD) > cap) & (F.col("_steps") > 0))
    match = ["bundle", "kind", "card", "at"]
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in match]
    staying = rows.alias("r").join(gone.alias("g"), on, "left_anti")
    long = staying.where("kind = 'evidence'").join(still, "bundle")
    sums = long.groupBy("bundle").agg(F.sum("_w").alias("_own"))
    # in these bundles three excerpts are left at most
    cut = long.join(sums, "bundle").withColumn("_other", F.col("_left") - F.col("_own")).select("bundle", "kind", "card", "at", "score", "text", "_other", "_steps")
    schema = items.select("bundle", "kind", "card", "at", "score", "text").schema
    halved = cut.groupBy("bundle").applyInPandas(_halved(cap), schema)
    as_is = staying.join(still.select("bundle", F.lit(True).alias("_still")), "bundle", "left").where("_still IS NULL OR kind <> 'evidence'")
    return as_is.select(*schema.names).unionByName(halved)


def context_status(tickers: DataFrame, items: DataFrame, since: Column) -> DataFrame:
    """ticker (trimmed, upper case; once), available_count, most_recent_at, needs_context: what there is on each ticker since then. items: ticker, captured_at."""
    asked = tickers.select(F.upper(F.trim("ticker")).alias("ticker")).where("ticker <> ''").distinct()
    seen = items.where(F.col("captured_at") >= since).groupBy("ticker").agg(F.count(F.lit(1)).alias("_n"), F.max("captured_at").alias("most_recent_at"))
    n = F.coalesce("_n", F.lit(0))
    return asked.join(seen, "ticker", "left").select("ticker", n.alias("available_count"), "most_recent_at", (n == 0).alias("needs_context"))
