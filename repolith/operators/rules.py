"""Architecture rules over files, imports and symbols: one plan per rule type, united.

A rule is a dict with ``id``, ``type`` and what its type needs; ``scope`` is a glob of the
files it holds for (all, without one). Types: no-import, require-import (``target`` glob),
layer-boundary (``from`` and ``to`` globs), naming-pattern (``kind``, ``pattern``),
max-dependencies (``most``), annotation-required (``kind``), file-pattern (``pattern`` glob).
``custom`` types map a name to a function of (rule, files, imports, symbols) that gives
violations itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions.scalars import glob_regex

Custom = Callable[[dict, DataFrame, DataFrame, DataFrame], DataFrame]
KINDS = "rule string, path string, detail string"


def _in(c: str, glob: str | None) -> Column:
    return F.col(c).rlike(glob_regex(glob)) if glob else F.lit(True)


def _plan(rule: dict, files: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame | None:
    scope, kind = rule.get("scope"), rule.get("type")
    held = files.filter(_in("path", scope))
    if kind == "no-import":
        return imports.filter(_in("path", scope) & _in("source", rule["target"])).select("path", F.col("source").alias("detail"))
    if kind == "require-import":
        return held.join(imports.filter(_in("source", rule["target"])).select("path"), "path", "left_anti").select("path", F.lit(rule["target"]).alias("detail"))
    if kind == "layer-boundary":
        return imports.filter(_in("path", rule["from"]) & _in("source", rule["to"])).select("path", F.col("source").alias("detail"))
    if kind == "naming-pattern":
        return symbols.filter(_in("path", scope) & (F.col("kind") == rule["kind"]) & ~F.col("name").rlike(rule["pattern"])).select("path", F.col("name").alias("detail"))
    if kind == "max-dependencies":
        return imports.filter(_in("path", scope)).groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > int(rule["most"])).select("path", F.col("n").cast("string").alias("detail"))
    if kind == "annotation-required":
        return symbols.filter(_in("path", scope) & (F.col("kind") == rule.get("kind", "class")) & F.col("documentation").isNull()).select("path", F.col("name").alias("detail"))
    if kind == "file-pattern":
        return held.filter(~F.col("path").rlike(glob_regex(rule["pattern"], anchored=True))).select("path", F.lit(rule["pattern"]).alias("detail"))
    return None


def violations(rules: Iterable[dict], files: DataFrame, imports: DataFrame, symbols: DataFrame, custom: dict[str, Custom] | None = None) -> DataFrame:
    """(rule, path, detail) of ``files`` (path), ``imports`` (path, source) and ``symbols`` (path, kind, name, documentation).

    Null paths break no rule; a type that is neither known nor custom gives none; no rules give no rows.
    """
    out = files.sparkSession.createDataFrame([], KINDS)
    for rule in rules:
        own = (custom or {}).get(rule.get("type", ""))
        d = own(rule, files, imports, symbols) if own else _plan(rule, files, imports, symbols)
        if d is not None:
            out = out.unionByName(d.filter("path is not null").select(F.lit(rule["id"]).alias("rule"), "path", F.col("detail").cast("string").alias("detail")))
    return out


def passed(rules: Iterable[dict], broken: DataFrame) -> DataFrame:
    """(rule): the rules without a violation."""
    ids = broken.sparkSession.createDataFrame([(r["id"],) for r in rules], "rule string")
    return ids.join(broken.select("rule").distinct(), "rule", "left_anti")
