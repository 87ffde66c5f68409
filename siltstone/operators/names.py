"""Names that look like one another, by the share of characters in their longest common blocks.

The share is twice the characters in common blocks over those of both names; blocks are found by taking the longest one,
then the longest ones to its left and to its right, and so on. Pairs that can reach a share are found without comparing
all with all. Names of S characters together with M of them in blocks leave S - 2M outside. Two blocks
in a row are parted by at least one of these, so there are at most S - 2M + 1 blocks, and all but the last character of each
begins a pair of neighbours that both names have. At a share r this makes (1.5 r - 1) S - 1 common pairs at least,
for which prefixes of the names' pairs, rare ones first, must meet.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import slug
from siltstone.shared import settled


#: So many common tokens of prefixes are asked for, where the bound allows it.
MATCHES = 3


def _tokens(width: int):
    """name, n, token: a name's stretches of width characters, repeats numbered, so that a name has each once."""

    def run(batches):
        for b in batches:
            out = []
            for name in b["name"].to_pylist():
                seen: Counter = Counter()
                for i in range(len(name) - width + 1):
                    x = name[i : i + width]
                    seen[x] += 1
                    out.append((name, len(name), f"{x}{seen[x]}"))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["name", "n", "token"])

    return run


def _met(names: DataFrame, width: int, ratio: float, need: Callable[[Column], Column]) -> DataFrame:
    """a, b (a < b) of fitting lengths whose prefixes meet; need: the common tokens that names with so many characters together must have."""
    tokens = settled(names.mapInArrow(_tokens(width), "name string, n int, token string"), "name-tokens")
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    placed = tokens.join(frequency, "token").withColumn("at", F.row_number().over(Window.partitionBy("name").orderBy("df", "token")))
    # tokens that only one name has come first, and meet no other: they make the prefix shorter
    held = placed.groupBy("name").agg(F.count(F.lit(1)).alias("kept"))
    shortest = F.greatest(F.lit(1), F.ceil(F.col("n") * ratio / (2 - ratio) - 1e-9))
    least = F.greatest(F.lit(1), F.ceil(need(F.col("n") + shortest) - 1e-9))
    # prefixes that are k - 1 tokens longer must meet in k of them
    k = F.least(F.lit(MATCHES), least)
    prefix = placed.join(held, "name").withColumn("k", k).where(F.col("at") <= F.col("kept") - least + F.col("k")).select("name", "n", "k", "token")
    a, b = prefix.toDF("a", "n_a", "k_a", "token"), prefix.toDF("b", "n_b", "k_b", "token")
    fits = (F.least("n_a", "n_b") * (2 - ratio) >= F.greatest("n_a", "n_b") * ratio - 1e-9) & (F.col("a") < F.col("b"))
    shared = a.join(b, "token").where(fits).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first(F.least("k_a", "k_b")).alias("k"))
    return shared.where("shared >= k").select("a", "b")


def candidates(names: DataFrame, ratio: float) -> DataFrame:
    """a, b (a < b): pairs of distinct names whose lengths and common stretches allow the share.

    Where the bound on pairs of neighbours asks for none, with names of few characters together, single characters must
    meet: half the share of all of them.
    """
    slope = 1.5 * ratio - 1
    met = _met(names, 2, ratio, lambda total: slope * total - 1)
    if 1 / slope >= 2:
        short = names.where(F.char_length("name") * (1 + ratio / (2 - ratio)) <= 1 / slope + 1e-9)
        met = met.unionByName(_met(short, 1, ratio, lambda total: ratio / 2 * total)).distinct()
    return met


def _ratios(ratio: float):
    def run(batches):
        matcher = SequenceMatcher()  # keeps what it works out for its second name
        for b in batches:
            found: list[float] = []
            for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True):
                common = sum((Counter(x) & Counter(y)).values())  # no block can hold more
                if 2 * common < ratio * (len(x) + len(y)) - 1e-9:
                    found.append(0.0)
                    continue
                matcher.set_seqs(x, y)
                found.append(matcher.ratio())
            yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(found, pa.float64())], ["a", "b", "ratio"])

    return run


def near_duplicates(names: DataFrame, name: str, ratio: float = 0.85, aliases: DataFrame | None = None) -> DataFrame:
    """a, b (a < b), ratio: distinct names that share `ratio` of their characters in common blocks, all such pairs.

    Names with a slash are paths and are left out, as are null and empty ones. aliases (alias, target, as slugs): pairs of which one is an alias of
    the other are known already. The ratio must be more than two thirds: below that the bound says nothing.
    """
    if not 2 / 3 < ratio <= 1:
        raise ValueError("the ratio must lie above 2/3")
    one = names.select(F.col(name).cast("string").alias("name")).where("name IS NOT NULL AND name <> ''").where(~F.contains("name", F.lit("/"))).distinct()
    met = candidates(settled(one, "names"), ratio)
    found = met.mapInArrow(_ratios(ratio), "a string, b string, ratio double").where(F.col("ratio") >= ratio)
    if aliases is None:
        return found
    known = aliases.select(F.col("alias").alias("x"), F.col("target").alias("y")).distinct()
    known = known.unionByName(known.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    slugs = found.withColumn("x", slug(F.col("a"))).withColumn("y", slug(F.col("b")))
    return slugs.join(known, ["x", "y"], "left_anti").select("a", "b", "ratio")


def top_suggestions(pairs: DataFrame, most: int = 50) -> DataFrame:
    """The pairs to look at first: those of the greatest ratios, at most `most`."""
    return pairs.orderBy(F.desc("ratio"), "a", "b").limit(most)
