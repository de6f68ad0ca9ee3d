"""Fixpoints over an edge relation (src, dst): bounded searches, depths, cycles, paths.

Every round joins the frontier only, drops what was seen with an anti join and cuts the
lineage, so plans stay short and a lost executor costs a round. Nothing is collected.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.session import cut

#: Rounds of trimming before the nodes that are left are coloured.
TRIMS = 6


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(reversed_edges(edges)).distinct()


def sources(edges: DataFrame) -> DataFrame:
    """(node): nodes with a way out and none in."""
    return edges.select(F.col("src").alias("node")).dropna().distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def sinks(edges: DataFrame) -> DataFrame:
    """(node): nodes with a way in and none out."""
    return sources(reversed_edges(edges))


def reach(edges: DataFrame, starts: DataFrame, max_depth: int = 10) -> DataFrame:
    """(start, node, depth): nodes reached from each start along edges, at their first depth.

    ``starts``: (start). A start on a cycle reaches itself again; depth is at least 1. Null
    ends are dropped, repeated edges and starts count once, no starts give no rows.
    """
    e = cut(edges.select("src", "dst").dropna().distinct())
    front = starts.select("start").dropna().distinct().select("start", F.col("start").alias("node"))
    out = None
    for depth in range(1, max_depth + 1):
        step = front.join(e, front["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct()
        if out is not None:
            step = step.join(out.select("start", "node"), ["start", "node"], "left_anti")
        front = cut(step)
        layer = front.withColumn("depth", F.lit(depth))
        if out is not None and front.isEmpty():
            break
        out = layer if out is None else out.unionByName(layer)
    return out


def layers(edges: DataFrame, starts: DataFrame, max_depth: int, mode: str = "first") -> DataFrame:
    """(hop, node) of a blast radius over several starts at once; hop 0 are the starts.

    ``first``: each node at its first hop only. ``cumulative``: hop h holds all nodes within
    1..h hops. ``layered``: hop h holds the direct neighbours of hop h - 1, repeats and all.
    """
    s = starts.select(F.col("start").alias("node")).dropna().distinct()
    zero = s.select(F.lit(0).alias("hop"), "node")
    if mode == "layered":
        e = edges.select("src", "dst").dropna().distinct()
        out, front = zero, s
        for hop in range(1, max_depth + 1):
            front = cut(front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node")).distinct())
            out = out.unionByName(front.select(F.lit(hop).alias("hop"), "node"))
        return out
    one = reach(edges, starts, max_depth).groupBy("node").agg(F.min("depth").alias("hop"))
    if mode == "cumulative":
        return zero.unionByName(one.select(F.explode(F.sequence(F.col("hop"), F.lit(max_depth))).alias("hop"), "node"))
    return zero.unionByName(one.join(s, "node", "left_anti").select("hop", "node"))


def depth_from_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth): shortest distance from nodes that nobody imports; 0 where none leads.

    Rounds go on until nothing new is reached, so chains may be of any length.
    """
    e = cut(edges.select("src", "dst").dropna().distinct())
    front = nodes.select("id").join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    seen = cut(front.withColumn("depth", F.lit(0)))
    front = seen
    for depth in count(1):
        step = front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        front = cut(step.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        # one table again now and then, so that the plan stays short on long chains
        seen = seen.unionByName(front) if depth % 8 else cut(seen.unionByName(front))
    return nodes.select("id").join(seen, "id", "left").select("id", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on cycles; the component is its largest node.

    Nodes without a way in or out are trimmed, TRIMS times a round at most. Then the largest
    id that reaches a node colours it, and within a colour what reaches back to that id is a component;
    each round takes at least the largest remaining node away, so the rounds end.
    """
    e = cut(edges.select("src", "dst").dropna().distinct())
    done = e.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    e = cut(e.filter("src <> dst"))
    out = None
    while True:
        size = e.count()
        for _ in range(TRIMS):
            e = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            n, size = size, e.count()
            if n == size:
                break
        if not size:
            break
        colour = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("c", F.col("node")))
        while True:  # the largest id that reaches each node
            best = e.join(colour, e["src"] == colour["node"]).groupBy("dst").agg(F.max("c").alias("b"))
            new = cut(colour.join(best, colour["node"] == best["dst"], "left").select("node", F.greatest("c", F.coalesce("b", "c")).alias("c"), (F.coalesce("b", "c") > F.col("c")).alias("moved")))
            colour = new.drop("moved")
            if new.filter("moved").isEmpty():
                break
        c1, c2 = colour.withColumnsRenamed({"node": "src", "c": "cs"}), colour.withColumnsRenamed({"node": "dst", "c": "cd"})
        inside = cut(e.join(c1, "src").join(c2, "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        got = cut(colour.filter("node = c").select("node", "c"))
        front = got
        while True:  # back from the colour's own node
            step = inside.join(front.withColumnRenamed("node", "dst"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct().join(got, ["node", "c"], "left_anti")
            front = cut(step)
            if front.isEmpty():
                break
            got = cut(got.unionByName(front))
        part = got.withColumnRenamed("c", "component")
        out = part if out is None else out.unionByName(part)
        e = cut(e.join(got.select(F.col("node").alias("src")), "src", "left_anti").join(got.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if out is None:
        return done
    sizes = out.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    out = out.join(sizes, "component", "left_semi").select("node", "component")
    return out.unionByName(done.join(out.select("node"), "node", "left_anti"))


def traced_paths(edges: DataFrame, entries: DataFrame, exits: DataFrame, max_depth: int | None = 10) -> DataFrame:
    """(entry, path): from each entry the shortest path to an exit, the smallest among equals.

    ``entries``: (start), ``exits``: (node). Without an exit in reach, there is no row.
    A ``max_depth`` of None goes on until nothing new is reached.
    """
    e = cut(edges.select("src", "dst").dropna().distinct())
    x = exits.select(F.col("node")).distinct()
    front = entries.select(F.col("start").alias("entry"), F.col("start").alias("node"), F.array("start").alias("path"))
    seen = front.select("entry", "node")
    found = None
    for _ in count() if max_depth is None else range(max_depth):
        step = front.join(e, front["node"] == e["src"]).select("entry", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.join(seen, ["entry", "node"], "left_anti").groupBy("entry", "node").agg(F.min("path").alias("path"))
        front = cut(step)
        hit = front.join(x, "node", "left_semi").groupBy("entry").agg(F.min("path").alias("path"))
        hit = hit if found is None else hit.join(found, "entry", "left_anti")
        found = cut(hit if found is None else found.unionByName(hit))
        front = front.join(found.select("entry"), "entry", "left_anti")
        seen = cut(seen.unionByName(front.select("entry", "node")))
        if front.isEmpty():
            break
    return found
