"""Ordered analytics on keys that may be hot.

A plain window puts all rows of a key into one task. Where the largest key has been counted
and fits (``fits``), that is the cheapest plan: one shuffle, however many columns are added.
Beyond that, the key's rows are cut into buckets of the order (time, position); windows run
within buckets and, over one summary row a bucket, across them, so a key that holds a third
of all rows is spread over as many tasks as it has buckets. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.session import cut

#: Rows of a key that one task may order.
MOST = 100_000


def fits(df: DataFrame, keys: Sequence[str]) -> bool:
    """Has no key more than MOST rows? Counts them all, partly before the shuffle; read ``df`` from a cut or a source."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= MOST


def by_time(c: Column | str, width: int | None = None, last: Column | None = None) -> list[Column]:
    """Buckets of a time in microseconds: days, else hours, minutes, seconds, or only of ``width``. Null times come first, rows with ``last`` in the end."""
    c = F.col(c) if isinstance(c, str) else c
    widths = [width] if width else [86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000]
    return [F.coalesce(F.when(last, F.lit(1 << 60)) if last is not None else F.lit(None).cast("long"), F.floor(c / F.lit(w)), F.lit(-(1 << 60))) for w in widths]


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column | Sequence[Column],
    prev: Sequence[str] = (),
    nxt: Sequence[str] = (),
    before_max: Sequence[str] = (),
    after_min: Sequence[str] = (),
    up_to_max: Sequence[str] = (),
    number: str | None = None,
    up_to_sum: Sequence[str] = (),
    whole: bool = False,
) -> DataFrame:
    """Add values of neighbouring rows in ``order`` within ``keys``.

    ``prev_c``/``next_c``: the value of the row before/after (null at the ends).
    ``max_before_c``: maximum over all earlier rows; ``min_after_c``: minimum over all
    later rows; ``max_upto_c``, ``sum_upto_c``: over earlier rows and this one. ``number``: name
    of a row number from 0. ``bucket`` must not decrease along ``order``; of several, each
    finer than the one before, the first is taken whose largest bucket fits a task
    (``by_time``), so a key with one hot day is split too. Rows whose keys are null are dropped. ``order`` should be total; ties come in any order. ``whole`` is for
    keys that ``fits`` has counted: plain windows then, without buckets.
    """
    keys, order = list(keys), list(order)
    d = df
    for k in keys:
        d = d.filter(F.col(k).isNotNull())
    if whole:
        w = Window.partitionBy(*keys).orderBy(*order)
        back, ahead, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
        add = [F.lag(c).over(w).alias(f"prev_{c}") for c in prev] + [F.lead(c).over(w).alias(f"next_{c}") for c in nxt]
        add += [F.max(c).over(back).alias(f"max_before_{c}") for c in before_max] + [F.max(c).over(upto).alias(f"max_upto_{c}") for c in up_to_max]
        add += [F.min(c).over(ahead).alias(f"min_after_{c}") for c in after_min] + [F.sum(c).over(upto).alias(f"sum_upto_{c}") for c in up_to_sum]
        return d.select("*", *add, *([(F.row_number().over(w) - 1).cast("long").alias(number)] if number else []))
    choices = [bucket] if isinstance(bucket, Column) else list(bucket)
    if len(choices) > 1:
        d = cut(d)
        choices = [b for b in choices[:-1] if fits(d.select(*keys, b.alias("_b")), [*keys, "_b"])][:1] or choices[-1:]
    d = d.withColumn("_b", choices[0])
    d = cut(d.repartition(*keys, "_b"))  # read twice below: without the cut, chained calls would double the work each time
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    wb = Window.partitionBy(*keys).orderBy("_b")
    wb_back, wb_ahead = wb.rowsBetween(Window.unboundedPreceding, -1), wb.rowsBetween(1, Window.unboundedFollowing)
    at = F.struct(*order)
    aggs, over, local = [F.count(F.lit(1)).alias("_n")], [], []
    if prev:
        aggs.append(F.max_by(F.struct(*prev), at).alias("_last"))
        over.append(F.lag("_last").over(wb).alias("_last"))
        local.append(F.lag(F.struct(*prev)).over(w).alias("_lag"))
    if nxt:
        aggs.append(F.min_by(F.struct(*nxt), at).alias("_first"))
        over.append(F.lead("_first").over(wb).alias("_first"))
        local.append(F.lead(F.struct(*nxt)).over(w).alias("_lead"))
    for c in {*before_max, *up_to_max}:
        aggs.append(F.max(c).alias(f"_mx_{c}"))
        over.append(F.max(f"_mx_{c}").over(wb_back).alias(f"_mx_{c}"))
    for c in before_max:
        local.append(F.max(c).over(back).alias(f"_bm_{c}"))
    for c in up_to_max:
        local.append(F.max(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_um_{c}"))
    for c in after_min:
        aggs.append(F.min(c).alias(f"_mn_{c}"))
        over.append(F.min(f"_mn_{c}").over(wb_ahead).alias(f"_mn_{c}"))
        local.append(F.min(c).over(ahead).alias(f"_am_{c}"))
    for c in up_to_sum:
        aggs.append(F.sum(c).alias(f"_sm_{c}"))
        over.append(F.coalesce(F.sum(f"_sm_{c}").over(wb_back), F.lit(0)).alias(f"_sm_{c}"))
        local.append(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_us_{c}"))
    if number:
        over.append(F.coalesce(F.sum("_n").over(wb_back), F.lit(0)).alias("_off"))
        local.append((F.row_number().over(w) - 1).alias("_rn"))
    summary = d.groupBy(*keys, "_b").agg(*aggs).select(*keys, "_b", *over)
    out = d.select("*", *local).join(summary, [*keys, "_b"])
    cols: list[Column] = [F.col(c) for c in df.columns]
    lag, lead = F.coalesce("_lag", "_last") if prev else None, F.coalesce("_lead", "_first") if nxt else None
    cols += [lag.getField(c).alias(f"prev_{c}") for c in prev]
    cols += [lead.getField(c).alias(f"next_{c}") for c in nxt]
    larger = lambda a, b: F.when(a.isNull() | (b > a), b).otherwise(a)
    smaller = lambda a, b: F.when(a.isNull() | (b < a), b).otherwise(a)
    cols += [larger(F.col(f"_bm_{c}"), F.col(f"_mx_{c}")).alias(f"max_before_{c}") for c in before_max]
    cols += [larger(F.col(f"_um_{c}"), F.col(f"_mx_{c}")).alias(f"max_upto_{c}") for c in up_to_max]
    cols += [smaller(F.col(f"_am_{c}"), F.col(f"_mn_{c}")).alias(f"min_after_{c}") for c in after_min]
    cols += [(F.col(f"_us_{c}") + F.col(f"_sm_{c}")).alias(f"sum_upto_{c}") for c in up_to_sum]
    if number:
        cols.append((F.col("_off") + F.col("_rn")).alias(number))
    return out.select(*cols)
