"""Data sources for git history and paged JSON collections."""

from __future__ import annotations

import json
import re
import subprocess
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from repolith.sources.text import next_link

_LOG = "sha string, author string, at long, subject string, is_merge boolean, is_revert boolean, reverts_sha string, path string, additions long, deletions long"


class GitLog(DataSource):
    """Commits and changed files of repositories on a shared disk: one partition a repository.

    Option ``path``: repositories separated by commas; ``max``: most commits of each. Binary
    files count as 0 lines. All commits count, those of merged branches too; a merge shows
    what it changes against its first parent. A repository without commits gives no rows,
    one that can't be read is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return _LOG

    def reader(self, schema: StructType) -> DataSourceReader:
        return _GitReader(dict(self.options))


class _GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots, self.most = options["path"].split(","), options.get("max")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r.strip()) for r in self.roots]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        args = ["git", "-C", partition.value, "log", "--numstat", "--no-renames", "--diff-merges=first-parent", "--format=%x01%H%x02%ae%x02%ct%x02%P%x02%s%x02%b%x03"]
        done = subprocess.run(args + ([f"-n{int(self.most)}"] if self.most else []), capture_output=True)
        if done.returncode and b"does not have any commits yet" not in done.stderr:
            raise RuntimeError(f"git log of {partition.value}: {done.stderr.decode('utf-8', 'replace').strip()}")
        for block in done.stdout.decode("utf-8", "replace").split("\x01")[1:]:
            head, _, files = block.partition("\x03")
            sha, author, at, parents, subject, body = head.split("\x02")
            m = re.search(r"This reverts commit ([0-9a-f]{7,40})", body)
            base = (sha, author, int(at) * 1_000_000, subject, len(parents.split()) > 1, bool(m or re.match(r"(?i)revert\b", subject)), m[1] if m else None)
            rows = [x.split("\t") for x in files.strip().split("\n") if x.count("\t") == 2]
            for a, r, path in rows:
                yield (*base, path, int(a) if a.isdigit() else 0, int(r) if r.isdigit() else 0)
            if not rows:
                yield (*base, None, 0, 0)


class PagedJson(DataSource):
    """Rows of a collection that comes in pages: files ``0.json``, ``1.json``, ... below each folder.

    A page is a list, or an object with ``values`` and perhaps ``next`` (the next page's
    name). A Link header kept beside a page (``0.json.link``) names the next one too. Options
    ``path`` (folders, by commas, one partition each), ``max`` (items of a folder) and
    ``budget_ms`` (time for a folder); what goes beyond sets ``truncated``. A page that is named
    twice ends the reading. The value column holds each item as JSON.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "collection string, page string, value string, truncated boolean"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folders, self.most = options["path"].split(","), int(options.get("max", 1 << 62))
        self.budget = float(options.get("budget_ms", "inf")) / 1000

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f.strip()) for f in self.folders]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        folder, page, seen, n, began = Path(partition.value), "0.json", set(), 0, time.monotonic()
        while page and page not in seen and (folder / page).exists():
            seen.add(page)
            data = json.loads((folder / page).read_text())
            values = data if isinstance(data, list) else data.get("values", [])
            more = f"{int(page.split('.')[0]) + 1}.json" if isinstance(data, list) and re.fullmatch(r"\d+\.json", page) else (data.get("next") if isinstance(data, dict) else None)
            beside = folder / f"{page}.link"
            if beside.exists():
                address = next_link(beside.read_text())
                more = address.rpartition("/")[2] if address else None
            late = time.monotonic() - began > self.budget
            for i, v in enumerate(values):
                if n >= self.most:
                    return
                n += 1
                last = i + 1 == len(values)
                cut_off = (n == self.most or late and last) and (i + 1 < len(values) or bool(more and (folder / more).exists()))
                yield (folder.name, page, json.dumps(v), cut_off)
            page = None if late else more


_REQUEST = "number long, title string, state string, draft boolean, user struct<login string>, created_at timestamp, updated_at timestamp, merged_at timestamp, closed_at timestamp, merge_commit_sha string, head struct<ref string, sha string>, base struct<ref string>, additions long, deletions long, changed_files int, reviews array<struct<submitted_at timestamp, state string>>"
_DEPLOYMENT = "id long, environment string, sha string, created_at timestamp, statuses array<struct<state string, created_at timestamp>>"
#: What the states of a deployment mean.
STATES = {"success": "success", "active": "success", "inactive": "success", "failure": "failure", "error": "failure", "queued": "pending", "pending": "pending", "waiting": "pending", "in_progress": "pending"}


def pull_requests(spark: SparkSession, folders: list[str], since_us: int = 0) -> DataFrame:
    """Requests of repositories (one folder of pages each): the newest state of each number that was updated since then.

    ``first_review`` is the first submitted review; without reviews it is null.
    """
    d = spark.read.format("paged_json").option("path", ",".join(folders)).load().select(F.col("collection").alias("repo"), F.from_json("value", _REQUEST).alias("r")).select("repo", "r.*")
    newest = Window.partitionBy("repo", "number").orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("merged_at"))
    d = d.filter("number is not null").withColumn("k", F.row_number().over(newest)).filter("k = 1").drop("k")
    state = F.when(F.col("merged_at").isNotNull(), "merged").otherwise(F.col("state"))
    d = d.filter(F.unix_micros("updated_at") >= since_us).withColumns({"state": state, "first_review": F.array_min(F.transform("reviews", lambda x: x["submitted_at"])), "review_count": F.coalesce(F.size("reviews"), F.lit(0))})
    return d.select("repo", "number", "title", F.col("user.login").alias("author"), "state", "draft", "created_at", "updated_at", "merged_at", "closed_at", "merge_commit_sha", F.col("head.ref").alias("head_branch"), F.col("head.sha").alias("head_sha"), F.col("base.ref").alias("base_branch"), "additions", "deletions", "changed_files", "first_review", "review_count")


def deployments(spark: SparkSession, folders: list[str], since_us: int = 0, environments: list[str] | None = None) -> DataFrame:
    """Deployments created since then in the given environments (case ignored; all, without a list), with the meaning of their latest state."""
    d = spark.read.format("paged_json").option("path", ",".join(folders)).load().select(F.col("collection").alias("repo"), F.from_json("value", _DEPLOYMENT).alias("r")).select("repo", "r.*")
    d = d.filter(F.unix_micros("created_at") >= since_us)
    if environments:
        d = d.filter(F.lower("environment").isin([e.lower() for e in environments]))
    latest = F.element_at(F.array_sort(F.transform("statuses", lambda x: F.struct(x["created_at"].alias("at"), x["state"].alias("state")))), -1)["state"]
    meaning = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return d.select("repo", "id", "environment", "sha", "created_at", F.coalesce(meaning[F.when(F.size("statuses") > 0, latest)], F.lit("unknown")).alias("status"))


def register(spark: SparkSession) -> None:
    for source in (GitLog, PagedJson):
        spark.dataSource.register(source)
