"""Choices that depend on what was chosen before, per group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within_budget(items: DataFrame, group: str, item: str, priority: str, cost: str, budget: float) -> DataFrame:
    """(group, item, place): by falling priority each item that still fits the budget; ties by item.

    Only items that can fit at all go to the group's task, without their other columns; null
    costs and priorities are left out.
    """

    def choose(d: pd.DataFrame) -> pd.DataFrame:
        left, out = budget, []
        for x, c in d.sort_values(["p", "x"], ascending=[False, True])[["x", "c"]].itertuples(index=False):
            if c <= left:
                left -= c
                out.append(x)
        return pd.DataFrame({group: d["g"].iloc[0], item: out, "place": range(1, len(out) + 1)})

    d = items.select(F.col(group).alias("g"), F.col(item).alias("x"), F.col(priority).cast("double").alias("p"), F.col(cost).cast("double").alias("c")).dropna().filter(F.col("c") <= budget)
    kinds = dict(items.dtypes)
    return d.groupBy("g").applyInPandas(choose, f"{group} {kinds[group]}, {item} {kinds[item]}, place long")


def star_clusters(pairs: DataFrame, group: str, a: str, b: str, weight: str, most: int = 5) -> DataFrame:
    """(group, anchor, member): greedy stars of pairs, heaviest anchors first, each item once, the largest ``most``."""

    def choose(d: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for x, y, w in d[[a, b, weight]].itertuples(index=False):
            near.setdefault(x, []).append((-w, y))
            near.setdefault(y, []).append((-w, x))
        used: set = set()
        stars = []
        for anchor in sorted(near, key=lambda x: (-len(near[x]), x)):
            if anchor in used:
                continue
            members = [m for _, m in sorted(near[anchor]) if m not in used]
            if members:
                used |= {anchor, *members}
                stars.append((anchor, members))
        stars.sort(key=lambda s: (-len(s[1]), s[0]))
        rows = [(d[group].iloc[0], anchor, m) for anchor, members in stars[:most] for m in members]
        return pd.DataFrame(rows, columns=[group, "anchor", "member"])

    return pairs.select(group, a, b, weight).dropna().groupBy(group).applyInPandas(choose, f"{group} string, anchor string, member string")


def test_costs(tests: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(path, seconds, flakiness) of tests (path): by their runs (path, seconds, failed) where there are any.

    Without runs an integration test takes ten seconds, another two. Flakiness is the share
    of failed runs, 0 below five of them.
    """
    usual = F.when(F.col("path").rlike("integration|e2e"), 10.0).otherwise(2.0)
    if history is None:
        return tests.select("path", usual.alias("seconds"), F.lit(0.0).alias("flakiness")).distinct()
    runs = history.groupBy("path").agg(F.avg("seconds").alias("mean"), F.count("*").alias("n"), F.count_if("failed").alias("bad"))
    flaky = F.when(F.col("n") >= 5, F.col("bad") / F.col("n")).otherwise(0.0)
    return tests.select("path").distinct().join(runs, "path", "left").select("path", F.coalesce("mean", usual).alias("seconds"), F.coalesce(flaky, F.lit(0.0)).alias("flakiness"))
