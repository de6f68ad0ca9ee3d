"""Joins of intervals that overlap, within equal keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], width: int = 64) -> DataFrame:
    """Rows of both sides whose closed integer ranges overlap and whose keys are equal.

    Ranges are met slot by slot (``width`` integers each), so a key with many ranges isn't
    compared all with all; a pair is kept in the slot where its common part begins, hence
    once. Rows with a null key or bound, or an end before its start, match nothing. Columns
    other than the keys must differ in name.
    """
    (a, b), (c, d) = left_range, right_range
    slots = lambda x, y: F.explode(F.sequence(F.floor(F.col(x) / width), F.floor(F.col(y) / width)))
    one = left.filter(F.col(a) <= F.col(b)).withColumn("_slot", slots(a, b))
    two = right.filter(F.col(c) <= F.col(d)).withColumn("_slot", slots(c, d))
    hit = one.join(two, [*keys, "_slot"]).filter((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)))
    return hit.filter(F.col("_slot") == F.floor(F.greatest(a, c) / width)).drop("_slot")
