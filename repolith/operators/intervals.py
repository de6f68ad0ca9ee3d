"""Merging intervals per entity into periods and gaps with dyadic blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.scalars import micros
from repolith.operators.ordered import by_time, fits, neighbours
from repolith.session import cut

#: A tile holds 2**TILE ranks, so never more than 2**(TILE + 1) distinct blocks.
TILE = 8
#: Stands for an end that isn't known yet.
OPEN = (1 << 62) - 1


def stays(events: DataFrame, keys: list[str], kind: str, at: str, bucket_us: int | None = None) -> DataFrame:
    """Turn enter/leave events into stays (keys, ``start``, ``end``; ``end`` null while open).

    Rows without key, time or a known kind are ignored, equal events count once, an
    enter while in and a leave while out change nothing; at one instant a leave comes
    before an enter. Other columns are not read. An empty table gives no stays.
    """
    k = F.lower(F.trim(F.col(kind)))
    e = events.select(*keys, k.alias("_kind"), micros(at).alias("_at")).filter(F.col("_at").isNotNull() & F.col("_kind").isin("enter", "leave"))
    e = e.withColumn("_in", (F.col("_kind") == "enter").cast("int")).drop("_kind").distinct()
    bucket = by_time("_at", bucket_us)
    e = e.withColumn("_out", F.when(F.col("_in") == 0, F.col("_at")))
    e = cut(e)
    e = neighbours(e, keys, ["_at", "_in"], bucket, prev=["_in"], after_min=["_out"], whole=fits(e, keys))
    return e.filter("_in = 1 and coalesce(prev__in, 0) = 0").select(*keys, F.col("_at").alias("start"), F.col("min_after__out").alias("end"))


def dyadic_blocks(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """Explode [lo, hi) into its canonical blocks: ``level``, ``idx`` covers [idx, idx+1) * 2**level."""
    left = f"((({lo}) + shiftleft(1L, k) - 1) div shiftleft(1L, k))"
    right = f"(({hi}) div shiftleft(1L, k))"
    blocks = (
        f"flatten(transform(sequence(0, cast(floor(log2({hi} - {lo}) + 1e-9) as int)), k -> filter(array("
        f"if({left} < {right} and {left} % 2 = 1, struct(k as level, {left} as idx), null),"
        f"if({left} < {right} and {right} % 2 = 1, struct(k as level, {right} - 1 as idx), null)), b -> b is not null)))"
    )
    # the topmost block of an aligned interval: an even left bound that reaches the right one
    return df.filter(f"{hi} > {lo}").select("*", F.explode(F.expr(blocks)).alias("_blk")).select("*", "_blk.level", "_blk.idx").drop("_blk")


def merged_periods(df: DataFrame, keys: list[str], start: str, end: str, bucket_us: int | None = None) -> DataFrame:
    """Merge intervals [start, end) per key; touching ones are merged too.

    Gives keys, ``span_kind`` (``period`` or ``gap``), ``start_us``, ``end_us`` (-1 while
    open). A null end is open, a null start or an end not after its start is ignored, an
    empty table gives no rows.

    Bounds are replaced by their rank within the key, so that blocks are few; each
    interval is decomposed into dyadic blocks, equal blocks are kept once, blocks above
    the tile size are cut into tiles, blocks covered by an ancestor are dropped, sibling
    pairs merge upward level by level, and adjacent blocks are coalesced.
    """
    d = df.select(*keys, F.col(start).cast("long").alias("_s"), F.coalesce(F.col(end).cast("long"), F.lit(OPEN)).alias("_e")).filter("_s < _e").distinct()
    d = cut(d)
    bound = d.select(*keys, F.explode(F.array("_s", "_e")).alias("_t")).distinct()
    at = by_time("_t", bucket_us, F.col("_t") == OPEN)
    # no later table has more rows of a key than there are bounds
    bound = cut(bound)
    whole = fits(bound, keys)
    ranks = cut(neighbours(bound, keys, ["_t"], at, number="_r", whole=whole).select(*keys, "_t", "_r"))
    lo, hi = ranks.withColumnsRenamed({"_t": "_s", "_r": "_lo"}), ranks.withColumnsRenamed({"_t": "_e", "_r": "_hi"})
    d = d.join(lo, [*keys, "_s"]).join(hi, [*keys, "_e"]).select(*keys, "_lo", "_hi").distinct()
    blocks = dyadic_blocks(d, "_lo", "_hi").select(*keys, "level", "idx").distinct()
    # what is larger than a tile becomes the roots of the tiles it covers
    roots = F.explode(F.expr(f"if(level > {TILE}, transform(sequence(0L, shiftleft(1L, level - {TILE}) - 1), i -> struct({TILE} as level, shiftleft(idx, level - {TILE}) + i as idx)), array(struct(level, idx)))"))
    blocks = blocks.select(*keys, roots.alias("_x")).select(*keys, "_x.level", "_x.idx")
    blocks = blocks.withColumn("_tile", F.expr(f"shiftright(idx, {TILE} - level)")).repartition(*keys, "_tile")
    blocks = blocks.groupBy(*keys, "_tile", "level", "idx").agg(F.lit(1).alias("_one")).drop("_one")
    # covered by an ancestor: blocks nest or are disjoint, so an earlier one that reaches as far covers
    w = Window.partitionBy(*keys, "_tile").orderBy(F.expr("shiftleft(idx, level)"), F.desc("level"))
    reach = F.max(F.expr("shiftleft(idx + 1, level)")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("_reach", reach).filter("_reach is null or _reach < shiftleft(idx + 1, level)").drop("_reach")
    for level in range(TILE):
        mine = F.col("level") == level
        blocks = (
            blocks.withColumns({"_up": F.when(mine, level + 1).otherwise(F.col("level")), "_ui": F.when(mine, F.shiftright("idx", 1)).otherwise(F.col("idx"))})
            .groupBy(*keys, "_tile", "_up", "_ui")
            .agg(F.count(F.lit(1)).alias("_n"), F.min("level").alias("level"), F.min("idx").alias("idx"))
            .select(*keys, "_tile", F.when(F.col("_n") > 1, F.col("_up")).otherwise(F.col("level")).alias("level"), F.when(F.col("_n") > 1, F.col("_ui")).otherwise(F.col("idx")).alias("idx"))
        )
    runs = blocks.select(*keys, "_tile", F.expr("shiftleft(idx, level)").alias("_from"), F.expr("shiftleft(idx + 1, level)").alias("_to"))
    runs = neighbours(runs, keys, ["_from"], F.col("_tile"), prev=["_to"], nxt=["_from"], whole=whole)
    edge = F.expr(
        "filter(array(if(prev__to is null or prev__to < _from, struct(_from as _r, 1 as _opens), null), if(next__from is null or next__from > _to, struct(_to as _r, 0 as _opens), null)), x -> x is not null)"
    )
    edges = runs.select(*keys, F.explode(edge).alias("_x")).select(*keys, "_x._r", "_x._opens").join(ranks, [*keys, "_r"])
    edges = neighbours(edges.drop("_r"), keys, ["_t"], at, nxt=["_t"], whole=whole)
    edges = edges.filter("next__t is not null")
    return edges.select(*keys, F.when(F.col("_opens") == 1, "period").otherwise("gap").alias("span_kind"), F.col("_t").alias("start_us"), F.when(F.col("next__t") == OPEN, F.lit(-1)).otherwise(F.col("next__t")).cast("long").alias("end_us"))
