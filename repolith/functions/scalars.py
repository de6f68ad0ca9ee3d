"""Scalar column helpers shared by the reports."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp, whatever the session's time zone."""
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def repo_key(c: Column | str) -> Column:
    """One spelling of a repository: lower case, no blanks, no trailing ``.git``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", ""), r"\.git$", "")


def path_key(c: Column | str) -> Column:
    """One spelling of a path: forward slashes, none doubled, no leading ``./``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/+", "/"), r"^(\./)+", "")


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounding half towards plus infinity."""
    return F.floor(c * F.lit(float(10**digits)) + F.lit(0.5)) / F.lit(float(10**digits))


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage, 0 where the whole is 0 or null."""
    return F.coalesce(half_up(F.try_divide(part * F.lit(100.0), whole), digits), F.lit(0.0))


def hours_between(a: Column | str, b: Column | str) -> Column:
    """Hours from a to b, never below 0, null if either is null."""
    return F.when(
        F.col(a).isNotNull() & F.col(b).isNotNull() if isinstance(a, str) else a.isNotNull() & b.isNotNull(),
        F.greatest(F.lit(0.0), (micros(b) - micros(a)) / F.lit(3.6e9)),
    )


def falsy(c: Column, default: object) -> Column:
    """``default`` where c is null, 0 or the empty string."""
    return F.coalesce(F.nullif(c, F.lit(0) if not isinstance(default, str) else F.lit("")), F.lit(default))


def glob_regex(glob: str, anchored: bool = False) -> str:
    """``**`` spans directories, ``*`` stays within one."""
    out = re.escape(glob).replace(r"\*\*", "\0").replace(r"\*", "[^/]*").replace("\0", ".*")
    return f"^{out}$" if anchored else out


def min_confidence(c: Column) -> Column:
    """Aggregate: low beats medium beats high; low for no rows."""
    rank = F.min(F.when(c == "low", 0).when(c == "medium", 1).otherwise(2))
    return F.when(rank.isNull() | (rank == 0), "low").when(rank == 1, "medium").otherwise("high")
