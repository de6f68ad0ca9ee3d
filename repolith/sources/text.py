"""Unified diffs, markdown sections and rules, link headers: small text formats as rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff_hunks(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, hunk, old_start, old_lines, new_start, new_lines, added, removed) of unified diffs.

    A missing count is 1. Lines before the first header belong to nothing; null texts give no rows.
    """
    d = diffs.select(key, F.posexplode(F.split(text, "\r?\n")).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n")
    path = F.regexp_extract("line", r"^diff --git a/.* b/(.*)$", 1)
    d = d.withColumn("path", F.last(F.when(path != "", path), ignorenulls=True).over(w))
    d = d.withColumn("opens", F.col("line").rlike(r"^@@ -\d+")).withColumn("file_opens", F.col("line").startswith("diff --git"))
    d = d.withColumn("hunk", F.sum(F.col("opens").cast("int")).over(w)).withColumn("inside", F.last(F.when(F.col("opens"), True).when(F.col("file_opens"), False), ignorenulls=True).over(w))
    part = lambda i: F.regexp_extract("head", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", i)
    g = d.filter("inside and path is not null").groupBy(key, "path", "hunk").agg(F.min_by("line", "n").alias("head"), F.count_if(F.col("line").startswith("+")).alias("added"), F.count_if(F.col("line").startswith("-")).alias("removed"))
    num = lambda i: F.when(part(i) == "", 1).otherwise(part(i).try_cast("int"))
    return g.select(key, "path", F.col("hunk").cast("int").alias("hunk"), num(1).alias("old_start"), num(2).alias("old_lines"), num(3).alias("new_start"), num(4).alias("new_lines"), "added", "removed")


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, level, title, slug, body) of markdown: a section ends at the next heading of its level or above."""
    d = docs.select(key, F.posexplode(F.split(text, "\r?\n")).alias("n", "line"))
    h = d.withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)))
    heads = h.filter("level > 0").select(key, F.col("n").alias("at"), "level", F.trim(F.regexp_replace("line", r"^#+\s+|\s*#+\s*$", "")).alias("title"))
    ends = heads.alias("a").join(heads.alias("b"), F.expr(f"a.{key} = b.{key} and b.at > a.at and b.level <= a.level"), "left").groupBy(F.col(f"a.{key}"), F.col("a.at"), F.col("a.level"), F.col("a.title")).agg(F.min("b.at").alias("stop"))
    body = ends.join(d, key).filter("n > at and (stop is null or n < stop)").groupBy(key, "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"))
    out = ends.join(body, [key, "at"], "left")
    return out.select(key, "level", "title", slug(F.col("title")).alias("slug"), F.coalesce("body", F.lit("")).alias("body"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def rules_of(markdown: str) -> list[dict]:
    """Rules of a markdown text: ``## ID: title`` with ``key: value`` lines below it."""
    out: list[dict] = []
    for line in (markdown or "").splitlines():
        if m := re.match(r"^##\s+([A-Z]+-\d+):\s*(.+?)\s*$", line):
            out.append({"id": m[1], "title": m[2]})
        elif out and (m := re.match(r"^\s*(?:[-*]\s*)?\**(\w[\w ]*?)\**\s*:\s*\**\s*(.+?)\s*$", line)):
            out[-1][m[1].strip().lower().replace(" ", "_")] = m[2].strip("`")
    return out


def next_link(header: str | None) -> str | None:
    """The address with rel="next" of a Link header."""
    for part in (header or "").split(","):
        m = re.match(r"\s*<([^>]*)>((?:\s*;\s*[^;]+)*)", part)
        if m and re.search(r"rel\s*=\s*\"?[^\";]*\bnext\b", m[2]):
            return m[1]
    return None
