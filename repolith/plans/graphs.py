"""Graph fixpoints over the dependency relation, with recursive SQL as oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith import relations as rel
from repolith.operators import graph

#: Modules whose change is studied.
SEEDS = [1, 5, 48, 97]


def _starts(s: SparkSession, ids: list[int] = SEEDS) -> DataFrame:
    return s.createDataFrame([(i,) for i in ids], "start long")


def _rev(s: SparkSession, d: str) -> DataFrame:
    return graph.reversed_edges(rel.edges(s, d))


def gr_02_transitive_dependents(s: SparkSession, d: str) -> DataFrame:
    return graph.reach(_rev(s, d), _starts(s), 4).select("start", "node")


def gr_03_blast_cumulative(s: SparkSession, d: str) -> DataFrame:
    return graph.layers(_rev(s, d), _starts(s), 2, "cumulative")


def gr_04_blast_layered(s: SparkSession, d: str) -> DataFrame:
    return graph.layers(_rev(s, d), _starts(s), 2, "layered")


def gr_05_blast_first(s: SparkSession, d: str) -> DataFrame:
    return graph.layers(_rev(s, d), _starts(s), 3, "first")


def gr_06_neighbourhood(s: SparkSession, d: str) -> DataFrame:
    return graph.layers(graph.both_ways(rel.edges(s, d)), _starts(s, [48]), 2, "first")


def gr_07_depth(s: SparkSession, d: str) -> DataFrame:
    return graph.depth_from_roots(rel.nodes(s, d), rel.edges(s, d))


def gr_08_cycles(s: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(rel.edges(s, d))


def gr_09_package_cycles(s: SparkSession, d: str) -> DataFrame:
    n = rel.nodes(s, d).select("id", "layer")
    ids = n.select("layer").distinct()
    e = rel.edges(s, d).join(n.withColumnsRenamed({"id": "src", "layer": "a"}), "src").join(n.withColumnsRenamed({"id": "dst", "layer": "b"}), "dst").filter("a <> b")
    e = e.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return graph.strong_components(e).join(ids.withColumnRenamed("layer", "node"), "node", "left_semi").select(F.col("node").alias("layer"), "component")


def gr_10_hot_paths(s: SparkSession, d: str) -> DataFrame:
    """From every module that nobody imports, the shortest path to one that imports nothing."""
    e = rel.edges(s, d)
    entries, exits = graph.sources(e), graph.sinks(e)
    p = graph.traced_paths(e, entries.withColumnRenamed("node", "start"), exits, None)
    return p.select("entry", F.element_at("path", -1).alias("exit"), F.size("path").cast("long").alias("steps"), F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def gr_12_processes(s: SparkSession, d: str) -> DataFrame:
    """From the six modules that import most, the twelve nearest of a walk of five steps; walks of one step are none."""
    top = rel.edges(s, d).groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(6).select(F.col("src").alias("start"))
    from pyspark.sql import Window

    steps = Window.partitionBy("start")
    near = graph.reach(rel.edges(s, d), top, 5).withColumn("place", F.row_number().over(steps.orderBy("depth", "node"))).filter("place <= 12")
    return near.withColumn("n", F.count("*").over(steps)).filter("n >= 2").select("start", "node", "depth", "place")


def gr_21_paths(s: SparkSession, d: str) -> DataFrame:
    return graph.reach(rel.edges(s, d), _starts(s, [1000, 1455, 1999]), 3).select("start", "node")


def gr_20_ad_hoc(s: SparkSession, d: str) -> DataFrame:
    from repolith.api import Engine

    return Engine(s, d).sql("with hubs as (select dst, count(*) as n from edges group by dst) select n.path, h.n from hubs h join nodes n on n.id = h.dst where h.n >= 3")


def gr_22_subgraph(s: SparkSession, d: str) -> DataFrame:
    """Edges among the neighbourhood of a module, the heaviest ten by size of the target."""
    near = graph.layers(graph.both_ways(rel.edges(s, d)), _starts(s, [12]), 2, "first").select("node")
    e = rel.edges(s, d).join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return e.join(rel.nodes(s, d).select(F.col("id").alias("dst"), "size"), "dst").select("src", "dst", "size").orderBy(F.desc("size"), "src", "dst").limit(10)


def imp_01_change_impact(s: SparkSession, d: str) -> DataFrame:
    """Modules a change reaches, with what they hold."""
    r = graph.reach(_rev(s, d), _starts(s, [30, 31]), 10)
    return r.join(rel.nodes(s, d).withColumnRenamed("id", "node"), "node").groupBy("start", "layer").agg(F.count("*").alias("modules"), F.sum("size").alias("size"))


def ref_01_waves(s: SparkSession, d: str) -> DataFrame:
    """Modules to change after a rename, in waves, with the wave's size and running total."""
    w = graph.layers(_rev(s, d), _starts(s, [7]), 6, "first").groupBy("hop").agg(F.count("*").alias("modules"))
    from pyspark.sql import Window

    return w.withColumn("so_far", F.sum("modules").over(Window.partitionBy(F.lit(0)).orderBy("hop")))  # one row a hop


def jn_06_hunk_overlap(s: SparkSession, d: str) -> DataFrame:
    """Symbols that a commit's changed lines touch; a file's hunk is taken from its line counts."""
    from repolith.operators.ranges import overlap_join

    h = rel.commit_files(s, d).select("repo", "path", "sha", (F.col("deletions") + 1).alias("from_line"), (F.col("deletions") + 1 + F.col("additions")).alias("to_line"))
    y = rel.symbols(s, d).select("repo", "path", "name", "line", F.coalesce("end_line", "line").alias("end_line"))
    return overlap_join(h, y, ["repo", "path"], ("from_line", "to_line"), ("line", "end_line")).select("sha", "path", "name", "line")


QUERIES = {k: v for k, v in list(globals().items()) if k[:3] in ("gr_", "imp", "ref", "jn_") and callable(v)}

_SEEDS = "(values " + ",".join(f"({i})" for i in SEEDS) + ")"


def _walk(edge: str, seeds: str, cap: int) -> str:
    return f"with recursive w(start, node, depth) as (select t.s, e.b, 1 from {seeds} t(s) join {edge} on e.a = t.s union select w.start, e.b, w.depth + 1 from w join {edge} on e.a = w.node where w.depth < {cap}), m as (select start, node, min(depth) depth from w group by 1, 2) "


_REV = "(select dst a, src b from {edges}) e"
_FWD = "(select src a, dst b from {edges}) e"
_ANY = "(select dst a, src b from {edges} union select src, dst from {edges}) e"
_FIRST = "select 0 hop, s node from {v} t(s) union all select min(depth), node from m where node not in (select s from {v} t(s)) group by node"
_REACH = "with recursive r(a, b) as (select src, dst from {edges} union select r.a, e.dst from r join {edges} e on e.src = r.b) "
_raw = {
    "gr_02_transitive_dependents": _walk(_REV, _SEEDS, 4) + "select start, node from m",
    "gr_03_blast_cumulative": _walk(_REV, _SEEDS, 2) + f"select 0 hop, s node from {_SEEDS} t(s) union all select distinct h, node from m join (values (1),(2)) x(h) on depth <= h",
    "gr_04_blast_layered": _walk(_REV, _SEEDS, 2) + f"select 0 hop, s node from {_SEEDS} t(s) union all select distinct depth, node from w",
    "gr_05_blast_first": _walk(_REV, _SEEDS, 3) + _FIRST.replace("{v}", _SEEDS),
    "gr_06_neighbourhood": _walk(_ANY, "(values (48))", 2) + _FIRST.replace("{v}", "(values (48))"),
    "gr_07_depth": "with recursive w(id, depth) as (select id, 0 from {nodes} where id not in (select dst from {edges}) union select e.dst, w.depth + 1 from w join {edges} e on e.src = w.id where w.depth < 200) select n.id, coalesce(min(depth), 0)::bigint depth from {nodes} n left join w on w.id = n.id group by n.id",
    "gr_08_cycles": _REACH + "select x.a node, max(y.b) component from r x join r y on y.a = x.a join r z on z.a = y.b and z.b = x.a where x.a = x.b group by x.a",
    "gr_09_package_cycles": "with recursive p as (select distinct a.layer src, b.layer dst from {edges} e join {nodes} a on a.id = e.src join {nodes} b on b.id = e.dst where a.layer <> b.layer), r(a, b) as (select src, dst from p union select r.a, p.dst from r join p on p.src = r.b) select x.a layer, max(y.b) component from r x join r y on y.a = x.a join r z on z.a = y.b and z.b = x.a where x.a = x.b group by x.a",
    # the shortest way of each entry to an exit, the smallest among equals
    "gr_10_hot_paths": "with recursive ent as (select distinct src from {edges} where src not in (select dst from {edges})), ex as (select distinct dst from {edges} where dst not in (select src from {edges})), w(entry, node, trail, k) as (select src, src, [src], 1 from ent union all select w.entry, e.dst, list_append(w.trail, e.dst), w.k + 1 from w join {edges} e on e.src = w.node where not list_contains(w.trail, e.dst) and w.node not in (select dst from ex)), b as (select entry, min(struct_pack(k := k, trail := trail)) m from w join ex on ex.dst = w.node group by entry) select entry, m.trail[-1] as exit, m.k::bigint steps, array_to_string(m.trail, '>') path from b",
    "gr_12_processes": "with recursive t as (select src s from {edges} group by src order by count(*) desc, src limit 6), w(start, node, depth) as (select t.s, e.dst, 1 from t join {edges} e on e.src = t.s union select w.start, e.dst, w.depth + 1 from w join {edges} e on e.src = w.node where w.depth < 5), m as (select start, node, min(depth) depth from w group by 1, 2), k as (select *, row_number() over (partition by start order by depth, node) place from m) select start, node, depth, place from (select *, count(*) over (partition by start) n from k where place <= 12) x where n >= 2",
    "gr_21_paths": _walk(_FWD, "(values (1000),(1455),(1999))", 3) + "select start, node from m",
    "gr_20_ad_hoc": "select n.path, h.n from (select dst, count(*) n from {edges} group by dst) h join {nodes} n on n.id = h.dst where h.n >= 3",
    "gr_22_subgraph": _walk(_ANY, "(values (12))", 2) + ", k as (select node from m union select 12) select e.src, e.dst, n.size from {edges} e join {nodes} n on n.id = e.dst where e.src in (select node from k) and e.dst in (select node from k) order by n.size desc, e.src, e.dst limit 10",
    "jn_06_hunk_overlap": "select c.sha, c.path, y.name, y.line from {commit_files} c join {symbols_} y on y.repo = c.repo and y.path = c.path and c.deletions + 1 <= coalesce(y.end_line, y.line) and y.line <= c.deletions + 1 + c.additions where y.line <= coalesce(y.end_line, y.line)",
    "imp_01_change_impact": _walk(_REV, "(values (30),(31))", 10) + "select start, layer, count(*) modules, sum(size)::bigint size from m join {nodes} n on n.id = m.node group by 1, 2",
    "ref_01_waves": _walk(_REV, "(values (7))", 6) + ", f as (" + _FIRST.replace("{v}", "(values (7))") + ") select hop, count(*) modules, sum(count(*)) over (order by hop)::bigint so_far from f group by hop",
}
SQL = {k: rel.oracle(v.replace(") , k as", "), k as")) for k, v in _raw.items()}
