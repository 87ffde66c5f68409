"""Scalar functions on texts and numbers, all built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column, longest: int | None = None) -> Column:
    """Lower-cased runs of ASCII letters and digits, joined by hyphens; cut to `longest` characters without a hyphen at its end."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return out if longest is None else F.regexp_replace(F.substring(out, 1, longest), "-+$", "")


def without_front_matter(text: Column) -> Column:
    """text without a leading block between two lines of ---."""
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---[ \t]*\n?", "")


def undated(name: Column) -> Column:
    """name without a leading date of the form 2024-01-31-."""
    return F.regexp_replace(name, r"^\d{4}-\d{2}-\d{2}-?", "")


def temporal_pair(a: Column, b: Column) -> Column:
    """Whether two names differ in nothing but their leading dates."""
    return (a != b) & (undated(a) == undated(b)) & (undated(a) != a) & (undated(b) != b)


def money_millions(text: Column) -> Column:
    """The first amount like "$1.2 billion" or "542 Million" in millions; null if there is none."""
    pattern = r"(?i)([0-9][0-9,]*\.?[0-9]*)\s*(trillion|billion|million|thousand)"
    amount = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    scale = F.when(unit == "trillion", 1e6).when(unit == "billion", 1e3).when(unit == "million", 1.0).when(unit == "thousand", 1e-3)
    return amount * scale


def money_value(text: Column) -> Column:
    """An amount that text starts with, after $ and without commas: millions for a unit with m, thousands of them with b, else as it stands."""
    plain = F.trim(F.regexp_replace(text, "[,$]", ""))
    amount = F.regexp_extract(plain, r"^([\d.]+)\s*([a-zA-Z]*)", 1).try_cast("double")
    unit = F.lower(F.substring(F.regexp_extract(plain, r"^([\d.]+)\s*([a-zA-Z]*)", 2), 1, 1))
    return F.when(unit == "b", amount * 1000).otherwise(amount)


def half_life(age: Column, half: float) -> Column:
    """1 at age 0 or less, halved with each `half` of age."""
    return F.exp(-F.ln(F.lit(2.0)) * F.greatest(age, F.lit(0.0)) / half)


def backoff_seconds(attempts: Column) -> Column:
    """30 seconds after the first failure, doubled with each further one, an hour at most."""
    return F.least(30 * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(3600.0))


def append_capped(items: Column, value: Column, cap: int = 3) -> Column:
    """items with value at the end unless it is there or empty; the last `cap`."""
    old = F.coalesce(items, F.array().cast("array<string>"))
    new = F.when((F.coalesce(value, F.lit("")) != "") & ~F.array_contains(old, value), F.array_append(old, value)).otherwise(old)
    return F.slice(new, F.greatest(F.size(new) - cap, F.lit(0)) + 1, cap)


def query_terms(text: Column, least: int = 2) -> Column:
    """A search text's terms: lower-cased ASCII words of `least` characters or more, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= least)


def approx_tokens(text: Column) -> Column:
    """Words times 1.3, rounded down."""
    return F.floor(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) * 1.3)


def next_run(now: Column, zone: str, hour: int, minute: int, weekdays_only: bool = True) -> Column:
    """The next instant at hour:minute in the zone after now (UTC), on a weekday."""
    local = F.from_utc_timestamp(now, zone)
    at = F.date_trunc("day", local) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))
    at = F.when(at <= local, at + F.make_dt_interval(F.lit(1))).otherwise(at)
    if weekdays_only:
        day = F.weekday(at)
        skip = F.when(day == 5, 2).when(day == 6, 1).otherwise(0)
        at = at + F.make_dt_interval(skip)
    return F.to_utc_timestamp(at, zone)
