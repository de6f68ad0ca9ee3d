"""Mixing sources to target weights by token blocks."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc, source, tokens) of (doc, source, text); a null text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(path)
        for d in batches:
            yield pd.DataFrame({"doc": d["doc"], "source": d["source"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in d["text"]]})

    return docs.select("doc", "source", "text").mapInPandas(run, "doc long, source string, tokens long")


def sainte_lague(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1), none above its cap; ties go to the first.

    If the caps don't hold all seats, the caps come out. The bulk is found by bisecting the
    divisor, the last seats by a heap, so the cost doesn't grow with the seats.
    """
    n = len(weights)
    ok = [i for i in range(n) if weights[i] > 0 and caps[i] > 0]
    if sum(caps[i] for i in ok) <= seats:
        return [caps[i] if i in set(ok) else 0 for i in range(n)]
    out = [0] * n
    if not ok or seats <= 0:
        return out
    given = lambda x: {i: min(caps[i], int(weights[i] * x + 0.5)) for i in ok}
    lo, hi = 0.0, 1.0
    while sum(given(hi).values()) <= seats:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(given(mid).values()) <= seats else (lo, mid)
    for i, k in given(lo).items():
        out[i] = max(0, k - 1)  # one less, the heap then settles ties
    heap = [(-weights[i] / (2 * out[i] + 1), i) for i in ok if out[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def _drawn(blocks: DataFrame, per_shard: DataFrame, quota: dict[str, tuple[int, int]], block_tokens: int, seed: int) -> DataFrame:
    """(source, shard, block, tokens, repeats) of the blocks that ``quota`` (source: seats, most repeats) draws."""
    given = blocks.sparkSession.createDataFrame([(s, q, m) for s, (q, m) in quota.items()], "source string, quota long, cap long")

    def to_shards(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("shard")
        cap = [int(t) * int(m) // block_tokens + 1 for t, m in zip(p["total"], p["cap"])]
        q = sainte_lague([float(x) for x in p["total"]], cap, int(p["quota"].iloc[0]))
        most = (p["total"] * p["cap"]).to_numpy()
        return pd.DataFrame({"source": p["source"], "shard": p["shard"], "total": p["total"], "long": p["long"], "cap": p["cap"], "goal": np.minimum(np.array(q, "i8") * block_tokens, most)})

    goals = per_shard.join(given, "source").select("source", "shard", "total", "long", "quota", "cap").groupBy("source").applyInPandas(to_shards, "source string, shard int, total long, long long, cap long, goal long")
    d = blocks.join(goals, ["source", "shard"]).filter("goal > 0").withColumns({"is_long": F.col("tokens") >= 2 * block_tokens, "whole": F.floor(F.col("goal") / F.col("total")), "left": F.col("goal") % F.col("total")})
    order = Window.partitionBy("source", "shard", "is_long").orderBy(F.xxhash64("block", "shard", F.lit(seed + 2)), "block").rowsBetween(Window.unboundedPreceding, 0)
    # a block is taken if its middle lies before the goal
    d = d.withColumn("middle", F.sum("tokens").over(order) - F.col("tokens") / 2)
    d = d.withColumn("long_taken", F.col("is_long") & (F.col("middle") <= F.col("left") * (F.col("long") / F.col("total"))))
    rest = F.col("left") - F.sum(F.when(F.col("long_taken"), F.col("tokens")).otherwise(0)).over(Window.partitionBy("source", "shard"))
    more = F.when(F.col("is_long"), F.col("long_taken")).otherwise(F.col("middle") <= F.col("rest"))
    d = d.withColumn("rest", rest).withColumn("repeats", F.least(F.col("cap"), F.col("whole") + more.cast("long")))
    return d.filter("repeats > 0").select("source", "shard", "block", "tokens", "repeats")


def mix(counts: DataFrame, targets: DataFrame, block_tokens: int = 2048, shard_tokens: int = 4_000_000, total_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Draw documents so that sources reach their target shares.

    ``counts``: (doc, source, tokens); ``targets``: (source, target_weight, max_repeats), one
    small row a source. Gives the drawn documents (doc, source, tokens, repeats) and a report
    per source. ``total_tokens`` is the size to reach, by default what the targeted
    sources hold. Sources without target or with a weight or cap that is null or not
    positive draw nothing; documents without source or tokens aren't drawn.

    Documents are spread over shards and ordered by a seeded hash; a seat is worth
    ``block_tokens``, and a document of many blocks counts as so many. Seats go to sources,
    then to each source's shards, by highest quotients; a shard gives the blocks that come
    nearest to its seats, long documents first in their share, so that short ones even out
    what these leave. The source with the longest block is drawn first, and the total follows what
    whole documents of it can reach, so that shares hold for heavy tails too.
    """
    docs = cut(counts.filter("source is not null and doc is not null and tokens > 0"))
    goal = targets.filter("source is not null").groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    shards = docs.groupBy("source").agg(F.sum("tokens").alias("t")).select("source", F.ceil(F.col("t") / shard_tokens).cast("int").alias("parts"))
    d = docs.join(shards, "source").select("doc", "source", "tokens", F.pmod(F.xxhash64("doc", F.lit(seed)), F.col("parts")).cast("int").alias("shard"), F.xxhash64("doc", F.lit(seed + 1)).alias("key"))
    w = Window.partitionBy("source", "shard").orderBy("key", "doc").rowsBetween(Window.unboundedPreceding, -1)
    d = cut(d.withColumn("block", F.floor(F.coalesce(F.sum("tokens").over(w), F.lit(0)) / block_tokens)))
    blocks = cut(d.groupBy("source", "shard", "block").agg(F.sum("tokens").alias("tokens")))
    per_shard = cut(blocks.groupBy("source", "shard").agg(F.sum("tokens").alias("total"), F.max("tokens").alias("longest"), F.sum(F.when(F.col("tokens") >= 2 * block_tokens, F.col("tokens")).otherwise(0)).alias("long")))
    # one row a source: as many as there are targets, however large the corpus
    rows = sorted(goal.join(per_shard.groupBy("source").agg(F.sum("total").alias("tokens"), F.max("longest").alias("longest")), "source").collect(), key=lambda r: r["source"])
    weights = [max(0.0, float(r["target_weight"] or 0)) for r in rows]
    repeats = [max(0, int(r["max_repeats"] or 0)) for r in rows]
    caps = [int(r["tokens"]) * m // block_tokens if int(r["tokens"]) * m >= block_tokens else min(1, m) for r, m in zip(rows, repeats)]
    total = sum(int(r["tokens"]) for r, x in zip(rows, weights) if x > 0) if total_tokens is None else total_tokens
    quota = sainte_lague(weights, caps, total // block_tokens)
    coarse = max((i for i in range(len(rows)) if 0 < quota[i] < caps[i]), key=lambda i: rows[i]["longest"], default=None)
    if coarse is not None and rows[coarse]["longest"] > block_tokens:
        source = rows[coarse]["source"]
        first = _drawn(blocks.filter(F.col("source") == source), per_shard, {source: (quota[coarse], repeats[coarse])}, block_tokens, seed)
        reached = first.agg(F.sum(F.col("tokens") * F.col("repeats"))).first()[0] or 0
        scale = reached / (quota[coarse] * block_tokens)
        rest = [0.0 if i == coarse else w for i, w in enumerate(weights)]
        others = sum(q for i, q in enumerate(quota) if i != coarse)
        again = sainte_lague(rest, caps, round(others * scale))
        quota = [q if i == coarse else again[i] for i, q in enumerate(quota)]
    drawn = _drawn(blocks, per_shard, {r["source"]: (q, m) for r, q, m in zip(rows, quota, repeats)}, block_tokens, seed)
    out = d.join(drawn.select("source", "shard", "block", "repeats"), ["source", "shard", "block"]).select("doc", "source", "tokens", "repeats")
    got = cut(out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.max("repeats").alias("most_repeats"), F.count(F.lit(1)).alias("docs")))
    have = docs.groupBy("source").agg(F.sum("tokens").alias("held_tokens"))
    all_drawn = got.agg(F.sum("drawn_tokens")).first()[0] or 0
    all_weight = goal.agg(F.sum(F.when(F.col("target_weight") > 0, F.col("target_weight")))).first()[0] or 0.0
    report = goal.join(have, "source", "full").join(got, "source", "left").fillna(0, ["held_tokens", "drawn_tokens", "most_repeats", "docs"])
    positive = F.when(F.col("target_weight") > 0, F.col("target_weight")).otherwise(0.0)
    report = report.select(
        "source", "target_weight", "max_repeats", "held_tokens", "drawn_tokens", "docs", "most_repeats",
        F.try_divide(positive, F.lit(float(all_weight))).alias("target_share"), F.coalesce(F.try_divide("drawn_tokens", F.lit(int(all_drawn))), F.lit(0.0)).alias("reached_share"),
    )
    return out, report
