"""Rules of the desk as columns: fields, weekdays, windows, cadences, quality of text, costs, severity and orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A bar's columns, and short names for sets of them (fixed values).
FIELDS = ("open", "high", "low", "close", "volume", "amount")
BAR = ("open", "high", "low", "close", "volume")
#: Days between two polls of a channel (fixed values).
CADENCE_DAYS = {"daily": 1, "weekly": 7}
#: Ranks of a source's tier and names of strengths from weakest (fixed values).
TIER_RANK = {"primary": 3, "reputable": 3, "secondary": 2, "low": 1}
STRENGTHS = ("none", "thin", "moderate", "strong")
#: Words that speak of leaving a position (fixed values).
EXITS = ("trim", "close", "sell", "short", "dump", "exit")


def bar_fields(spec: str | None) -> tuple[str, ...]:
    """The columns that a request names: an initial, ohlc, ohlcv, all, or names with commas; unknown ones go, and open to volume is what is left of nothing."""
    asked = (spec or "").strip().lower()
    if asked == "all":
        return FIELDS
    if asked in ("ohlc", "ohlcv"):
        return BAR[: len(asked)]
    if len(asked) == 1:
        return tuple(f for f in FIELDS if f[0] == asked) or BAR
    return tuple(f for f in (p.strip() for p in asked.split(",")) if f in FIELDS) or BAR


def on_weekdays(day: Column, spec: str | None) -> Column:
    """Whether day is one of the weekdays listed with commas (Monday is 0); true where the list names no weekday."""
    days = sorted({int(p) for p in (spec or "").split(",") if p.strip().lstrip("+-").isdecimal()} & set(range(7)))
    return F.weekday(day).isin(days) if days else F.lit(True)


def passes_quality(text: Column, least: int, ratio: float) -> Column:
    """Whether text has `least` letters and digits or more, which make up `ratio` or more of all that isn't blank; false for null."""
    body = F.coalesce(text, F.lit(""))
    alnum = F.length(F.regexp_replace(body, r"[^\p{L}\p{N}]", ""))
    solid = F.length(F.regexp_replace(body, r"[\s\p{Z}]", ""))
    return (solid > 0) & (alnum >= least) & (alnum >= ratio * solid)


def in_trigger_window(expected: Column, now: Column, before: Column | int, after: Column | int, zone: str = "America/New_York") -> Column:
    """Whether the zone's day of the instant now (UTC) lies from `before` days ahead of the expected day to `after` days past it; false for null."""
    ahead = F.datediff(expected, F.to_date(F.from_utc_timestamp(now, zone)))
    return F.coalesce(ahead.between(-(after if isinstance(after, Column) else F.lit(after)), before if isinstance(before, Column) else F.lit(before)), F.lit(False))


def upcoming(day: Column, today: Column, days: int) -> Column:
    """Whether day is today or one of the next `days`."""
    return F.coalesce(F.datediff(day, today).between(0, days), F.lit(False))


def is_due(enabled: Column, cadence: Column, last: Column, now: Column) -> Column:
    """Whether an enabled daily or weekly channel was polled (text of an instant, UTC) that long ago; one never polled, or at no readable time, is due."""
    gap = F.coalesce(*[F.when(F.lower(cadence) == name, F.lit(days * 86_400)) for name, days in CADENCE_DAYS.items()])
    since = F.unix_seconds(now) - F.unix_seconds(F.try_to_timestamp(last))
    return F.coalesce(enabled, F.lit(False)) & gap.isNotNull() & F.coalesce(since >= gap, F.lit(True))


def speaks_of_exit(text: Column) -> Column:
    """Whether a text names leaving a position in a word of its own; false for null."""
    return F.coalesce(text.rlike(rf"(?i)\b({'|'.join(EXITS)})\b"), F.lit(False))


def delta_band(forecast: Column, actual: Column, flat: float = 1.0) -> Column:
    """up, down or flat by the forecast's distance from the actual in percent; null where that can't be taken."""
    pct = (forecast - actual) / F.nullif(actual, F.lit(0.0)) * 100
    return F.when(pct > flat, "up").when(pct < -flat, "down").when(pct.isNotNull(), "flat")


def token_cost(tokens_in: Column, tokens_out: Column, per_million_in: float, per_million_out: float) -> Column:
    """Cost of a call by its tokens, to six places; null counts count as 0."""
    zero = F.lit(0)
    return F.round((F.coalesce(tokens_in, zero) * per_million_in + F.coalesce(tokens_out, zero) * per_million_out) / 1e6, 6)


def place_in(value: Column, order: Sequence[str]) -> Column:
    """The value's place in a stated order, from 0; all others come after it."""
    return F.coalesce(*[F.when(value == v, F.lit(i)) for i, v in enumerate(order)], F.lit(len(order)))


def content_key(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns as one JSON object with its keys in order; a null is left out."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def _in_order(value: Column, kind: T.DataType) -> Column:
    """The value with the names in all structs and the keys of all maps inside it in order."""
    if isinstance(kind, T.StructType):
        fields = [_in_order(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(value))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: _in_order(F.element_at(value, k), kind.valueType)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _in_order(x, kind.elementType))
    return value


def nested_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """As content_key(), for columns of df that may hold structs, maps and arrays: equal objects get one key, however their names are ordered."""
    return F.sha2(F.to_json(F.struct(*[_in_order(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(columns)])), 256)


def severity(pairs: Column, contradicting: Column, stale: Column) -> Column:
    """high for a contradictory pair or two sources against, medium for one, low for stale ones alone, else none; nulls are 0."""
    p, c, s = (F.coalesce(x, F.lit(0)) for x in (pairs, contradicting, stale))
    return F.when((p >= 1) | (c >= 2), "high").when(c == 1, "medium").when(s > 0, "low").otherwise("none")


def credibility(publishers: Column, best_tier: Column, claimed: Column) -> Column:
    """A counter-claim's strength by its sources: none without a publisher, thin with one, strong with three and a tier of 3, else moderate; never above its own claim."""
    own = F.when(publishers == 0, 0).when(publishers == 1, 1).when((publishers >= 3) & (best_tier >= 3), 3).otherwise(2)
    said = F.least(place_in(F.lower(F.coalesce(claimed, F.lit("none"))), STRENGTHS), F.lit(3))
    return F.get(F.array(*[F.lit(s) for s in STRENGTHS]), F.least(own, said))
