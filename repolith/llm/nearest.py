"""Pairing records with the nearest record in time of the same entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.operators.ordered import by_time, fits, neighbours
from repolith.session import cut

#: Ratio of the slot widths of successive levels of the interval index.
WIDEN = 16


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_us: int) -> DataFrame:
    """For each left row (anchor_id, entity, t) the right row (matched_id, entity, t) nearest in time.

    Times are integers (microseconds). At most ``tolerance_us`` apart, before or after; at
    equal distance the smaller id. Rows with a null in one of the three columns match
    nothing, repeated rows count once, an anchor id with several times keeps its nearest
    pair. Gives anchor_id, matched_id, distance_us.

    Each right time owns the interval up to the midpoints with its neighbours, cut at the
    tolerance, so an entity's intervals don't overlap. Intervals are indexed by their size:
    level l holds those longer than WIDEN^(l-1) and no longer than WIDEN^l, in slots of WIDEN^l, of
    which no more than WIDEN + 1 meet a slot, however dense the entity is there. Left times
    are range-joined within their slot of every level that the entity has.
    """
    r = right.select("entity", "t", "matched_id").dropna().groupBy("entity", "t").agg(F.min("matched_id").alias("matched_id"))
    r = cut(r)
    r = neighbours(r, ["entity"], ["t"], by_time("t"), prev=["t"], nxt=["t"], whole=fits(r, ["entity"]))
    lo = F.greatest(F.col("t") - tolerance_us, F.ceil((F.col("prev_t") + F.col("t")) / 2))
    hi = F.least(F.col("t") + tolerance_us, F.floor((F.col("next_t") + F.col("t")) / 2))
    r = r.select("entity", F.col("t").alias("rt"), "matched_id", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    hit = _met(left.select("entity", "t", "anchor_id").dropna().distinct(), r).filter("t between lo and hi")
    best = F.min(F.struct(F.abs(F.col("t") - F.col("rt")).alias("d"), F.col("matched_id").alias("m"))).alias("x")
    return hit.groupBy("anchor_id").agg(best).select("anchor_id", F.col("x.m").alias("matched_id"), F.col("x.d").alias("distance_us"))


def _met(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Points (entity, t, ...) with the disjoint intervals (entity, lo, hi, ...) whose slot they are in."""
    powers = F.array(*[F.lit(WIDEN**k) for k in range(12)])
    level = F.array_position(F.transform(powers, lambda x: F.col("hi") - F.col("lo") + 1 <= x), True).cast("int") - 1
    slot = lambda c: F.floor(F.col(c) / F.element_at(powers, F.col("level") + 1)).cast("long")
    r = intervals.filter("lo <= hi").withColumn("level", level)
    levels = r.groupBy("entity").agg(F.collect_set("level").alias("levels"))  # a dozen at most
    r = r.withColumn("slot", F.explode(F.sequence(slot("lo"), slot("hi"))))
    a = points.join(levels, "entity").withColumn("level", F.explode("levels")).withColumn("slot", slot("t")).drop("levels")
    return a.join(r, ["entity", "level", "slot"])
