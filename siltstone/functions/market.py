"""Predicates on symbols, days and labels, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends of the names of crypto pairs, written with a dash and without (fixed values).
DASH_PAIRS = ("-USD", "-USDT", "-USDC")
PAIRS = ("USDT", "USDC", "BUSD", "BTC", "ETH")
#: Classes that trade on weekdays only (fixed values).
WEEKDAY_CLASSES = ("stock", "etf", "forex", "futures")


def symbol_key(symbol: Column) -> Column:
    """The symbol in upper case without blanks around it; null if nothing is left."""
    key = F.upper(F.trim(symbol))
    return F.when(F.length(key) > 0, key)


def asset_class(symbol: Column, etfs: Sequence[str] = ()) -> Column:
    """crypto, etf (one of etfs, in upper case) or stock; a null or empty symbol is a stock."""
    s = F.coalesce(symbol_key(symbol), F.lit(""))
    dashed = F.lit(False)
    for end in DASH_PAIRS:
        dashed = dashed | s.endswith(end)
    joined = F.lit(False)
    for end in PAIRS:
        joined = joined | (s.endswith(end) & (F.length(s) >= len(end) + 2))
    return F.when(dashed, "crypto").when(s.isin(*etfs) if etfs else F.lit(False), "etf").when((F.length(s) > 4) & joined, "crypto").otherwise("stock")


def is_trading_day(asset: Column, day: Column) -> Column:
    """Whether the class trades on that day: stocks, ETFs, forex and futures on weekdays, all others and unknown ones always."""
    return ~(F.coalesce(F.lower(F.trim(asset)), F.lit("")).isin(*WEEKDAY_CLASSES) & (F.weekday(day) >= 5))


def label_filters(spec: Column) -> Column:
    """The (key, value) pairs of a filter like "sector:tech,insider_buy:true"; parts without a key or a value are left out.

    A value keeps its JSON form where it is JSON (true, 3, "x"), and is a JSON string otherwise, so that filters and stored labels compare as text.
    """
    parts = F.filter(F.split(F.coalesce(spec, F.lit("")), ","), lambda p: F.instr(p, ":") > 0)

    def pair(part: Column) -> Column:
        at = F.instr(part, ":")
        raw = F.trim(F.substr(part, at + 1))
        text = F.concat(F.lit('"'), F.regexp_replace(raw, r'(["\\\\])', r"\\\\$1"), F.lit('"'))
        is_json = raw.rlike(r'^(true|false|null|-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?|"[^"\\]*")$')
        return F.struct(F.trim(F.substr(part, F.lit(1), at - 1)).alias("key"), F.when(F.length(raw) > 0, F.when(is_json, raw).otherwise(text)).alias("value"))

    return F.filter(F.transform(parts, pair), lambda p: (F.length(p["key"]) > 0) & p["value"].isNotNull())
