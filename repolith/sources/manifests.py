"""Package manifests of a workspace and team files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The dependency sections of a manifest, the first one found counts.
SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]


def packages(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Packages (path, name, version, private) and their dependencies (name, dependency, range, section).

    Reads every ``package.json`` below ``root`` but those of installed modules. A file that
    isn't JSON gives nothing; a dependency in several sections counts in the first.
    """
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "package.json").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    t = t.filter(~F.col("path").contains("/node_modules/"))
    fields = "name string, version string, private boolean, " + ", ".join(f"{s} map<string,string>" for s in SECTIONS)
    p = t.select("path", F.from_json("value", fields).alias("j")).filter("j.name is not null")
    deps = [p.select(F.col("j.name").alias("name"), F.explode(f"j.{s}").alias("dependency", "range"), F.lit(i).alias("i")) for i, s in enumerate(SECTIONS)]
    all_ = deps[0]
    for d in deps[1:]:
        all_ = all_.unionByName(d)
    first = all_.groupBy("name", "dependency").agg(F.min(F.struct("i", "range")).alias("x"))
    names = F.array(*map(F.lit, SECTIONS))
    return p.select("path", "j.name", "j.version", F.coalesce("j.private", F.lit(False)).alias("private")), first.select("name", "dependency", F.col("x.range").alias("range"), names[F.col("x.i")].alias("section"))


def mismatched(deps: DataFrame) -> DataFrame:
    """(dependency, ranges): dependencies that several packages use in different ranges."""
    return deps.groupBy("dependency").agg(F.sort_array(F.collect_set("range")).alias("ranges"), F.count("*").alias("users")).filter("users > 1 and size(ranges) > 1").select("dependency", "ranges")


def local_links(pkgs: DataFrame, deps: DataFrame) -> DataFrame:
    """(src, dst) of packages that use each other's."""
    return deps.join(pkgs.select(F.col("name").alias("dependency")), "dependency", "left_semi").select(F.col("name").alias("src"), F.col("dependency").alias("dst"))


def teams(spark: SparkSession, text: str) -> DataFrame:
    """(team, repo, project) of a JSON list of teams with ``name``, ``repos`` and ``projects``; blanks are trimmed, empty names dropped."""
    rows = []
    for t in json.loads(text or "[]"):
        name = str(t.get("name") or "").strip()
        if name:
            rows += [(name, r, p) for r in ([x.strip() for x in t.get("repos") or []] or [None]) for p in ([x.strip() for x in t.get("projects") or []] or [None])]
    return spark.createDataFrame(rows, "team string, repo string, project string")
