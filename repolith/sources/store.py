"""Snapshots, the stored graph, registries and renderers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.session import cut

BUCKETS = 64


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, hash) of (path, text); the hash is that of the content, a null text is an empty one."""
    return files.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, deleted, changed or unchanged between two ``fingerprints``."""
    o, n = old.select("path", F.col("hash").alias("was")), new.select("path", F.col("hash").alias("now"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed").otherwise("unchanged")
    return o.join(n, "path", "full").select("path", state.alias("change"))


def snapshot_is_valid(snapshot: DataFrame, listing: DataFrame, written_us: int, now_us: int, max_age_us: int = 3_600_000_000) -> bool:
    """A snapshot holds while it is young, lists the same paths, and nothing was modified after it.

    ``listing``: path, modified_us.
    """
    if now_us - written_us > max_age_us:
        return False
    paths = snapshot.select("path")
    extra = listing.join(paths, "path", "left_anti").limit(1).unionByName(paths.join(listing, "path", "left_anti").limit(1), allowMissingColumns=True)
    return extra.isEmpty() and listing.filter(F.col("modified_us") > written_us).isEmpty()


VERSION = 1


def write_snapshot(files: DataFrame, folder: str, now_us: int) -> None:
    """Keep (path, text) with the hash of each text, the version and the time of writing."""
    d = files.select("path", "text").join(fingerprints(files), "path")
    d.withColumns({"version": F.lit(VERSION), "written_us": F.lit(now_us)}).write.mode("overwrite").parquet(folder)


def read_snapshot(spark: SparkSession, folder: str, listing: DataFrame, now_us: int, max_age_us: int = 3_600_000_000) -> DataFrame | None:
    """What ``write_snapshot`` kept, if it still holds for ``listing`` (path, modified_us); None if it is missing, of another version or outdated."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    d = spark.read.parquet(folder)
    head = d.agg(F.min("version").alias("low"), F.max("version").alias("high"), F.min("written_us").alias("at")).first()
    if head["low"] != VERSION or head["high"] != VERSION or not snapshot_is_valid(d, listing, head["at"], now_us, max_age_us):
        return None
    return d.drop("version", "written_us")


def sync_commits(commits: DataFrame, touched: DataFrame, functions: DataFrame, folder: str) -> None:
    """Replace the stored commits, which files they touched and which functions; all three are written anew."""
    for name, d in (("commits", commits), ("modified_in", touched), ("function_modified_in", functions)):
        d.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_index(vectors: DataFrame, folder: str) -> None:
    """Keep hashed vectors (key, idx, value), by key."""
    vectors.write.mode("overwrite").parquet(folder)


def read_index(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A kept index; an empty one of that schema if it is missing or can't be read."""
    try:
        d = spark.read.schema(schema).parquet(folder)
        d.limit(1).collect()
        return d
    except Exception:
        return spark.createDataFrame([], schema)


def append_sessions(rows: DataFrame, folder: str) -> None:
    """Add finished sessions to those kept; nothing is rewritten."""
    rows.write.mode("append").parquet(folder)


def write_graph(tables: dict[str, DataFrame], folder: str) -> None:
    """Write node and relation tables anew, partitioned by a bucket of the file they stem from (column ``path``)."""
    for name, d in tables.items():
        d.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(BUCKETS))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")


def upsert_graph(spark: SparkSession, tables: dict[str, DataFrame], affected: DataFrame, folder: str) -> None:
    """Replace the rows of ``affected`` paths (changed, deleted, and what depends on them) by those given.

    Only buckets that hold an affected path or a new row are rewritten.
    """
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        for name, d in tables.items():
            hit = affected.select("path").distinct()
            bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS))
            # a list of at most BUCKETS numbers
            dirty = [r[0] for r in hit.select(bucket.alias("b")).union(d.select(bucket.alias("b"))).distinct().collect()]
            old = spark.read.parquet(f"{folder}/{name}").filter(F.col("bucket").isin(dirty)).join(hit, "path", "left_anti")
            new = cut(old.unionByName(d.withColumn("bucket", bucket)))
            new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")
            # an overwrite leaves buckets alone that get no row: those are emptied
            full = {r[0] for r in new.select("bucket").distinct().collect()}
            for b in set(dirty) - full:
                at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/bucket={b}")
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def merged(registry: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """A registry with rows of the same key replaced."""
    return registry.join(updates.select(key), key, "left_anti").unionByName(updates, allowMissingColumns=True)


#: Roots and levels of a rendered tree.
ROOTS, DEEPEST = 20, 5

# --- renderers: of a bounded number of rows, stated by the caller


def render_edges(edges: DataFrame, style: str = "mermaid", most: int = 100) -> str:
    """The first ``most`` edges by name as mermaid, dot, ascii, json, html or a tree from their roots."""
    import json

    rows = [(str(r[0]), str(r[1])) for r in edges.select("src", "dst").dropna().distinct().orderBy("src", "dst").limit(most).collect()]
    if style == "dot":
        return "digraph {\n" + "".join(f"  {json.dumps(a)} -> {json.dumps(b)};\n" for a, b in rows) + "}"
    if style == "json":
        return json.dumps({"nodes": sorted({x for r in rows for x in r}), "edges": rows})
    if style == "ascii":
        return "\n".join(f"{a} --> {b}" for a, b in rows)
    if style == "tree":
        below: dict[str, list[str]] = {}
        for a, b in rows:
            below.setdefault(a, []).append(b)
        roots = sorted(set(below) - {b for _, b in rows}) or sorted(below)[:1]

        def lines(node: str, deep: int, seen: tuple) -> list[str]:
            under = [] if node in seen or deep >= DEEPEST else [x for c in below.get(node, []) for x in lines(c, deep + 1, (*seen, node))]
            return ["  " * deep + node, *under]

        return "\n".join(x for r in roots[:ROOTS] for x in lines(r, 0, ()))
    if style == "html":
        from html import escape

        items = "".join(f"<li>{escape(a)} &rarr; {escape(b)}</li>" for a, b in rows)
        return f"<!doctype html><meta charset=utf-8><title>Dependencies</title><ul>{items}</ul>"
    ids = {n: f"n{i}" for i, n in enumerate(sorted({x for r in rows for x in r}))}
    return "graph TD\n" + "".join(f'  {ids[a]}["{a}"] --> {ids[b]}["{b}"]\n' for a, b in rows)


def render_changelog(entries: DataFrame, style: str = "markdown", most: int = 1000) -> str:
    """Entries (kind, title) by kind as markdown, plain text or json."""
    import json

    rows = entries.select("kind", "title").orderBy("kind", "title").limit(most).collect()
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r["kind"], []).append(r["title"])
    if style == "json":
        return json.dumps(by)
    head, item = ("## {}", "- {}") if style == "markdown" else ("{}:", "  {}")
    return "\n".join(x for k, v in by.items() for x in [head.format(k.capitalize()), *map(item.format, v)])
