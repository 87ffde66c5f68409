"""Paths of notes: scopes by folder and classes by glob."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _forward(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def _under(path: Column, folder: str) -> Column:
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")


def in_scope(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Whether a path lies in none of the excluded folders, and in one of the included ones if there are any. A null path is in no scope."""
    own = _forward(path)
    out = reduce(lambda a, f: a & ~_under(own, f), exclude, F.lit(True))
    if include:
        out = out & reduce(lambda a, f: a | _under(own, f), include, F.lit(False))
    return F.coalesce(out & path.isNotNull(), F.lit(False))


def matches_glob(path: Column, globs: Sequence[str]) -> Column:
    """Whether one of the globs matches the whole path; null if there are no globs. A * goes over slashes, case counts."""
    if not globs:
        return F.lit(None).cast("boolean")
    own = _forward(path)
    patterns = [fnmatch.translate(g).removesuffix("\\Z").removesuffix("\\z") for g in globs]
    return reduce(lambda a, p: a | own.rlike(rf"\A(?:{p})\z"), patterns, F.lit(False))
