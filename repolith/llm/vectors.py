"""The k most similar vectors of every vector: one HNSW graph a shard, shard results merged.

Vectors go to the shard of their nearest centroid. They are searched for there and

* with a least similarity t, in every shard that may be the home of a vector so similar: one
  at t from q has q's component t along q and the rest in a random direction, so the difference of
  its cosines to two centroids a and b deviates by sqrt(1 - t^2) |a - b| / sqrt(dims); shards
  further behind than SIGMAS such deviations are left out, whatever their number;
* without one, in a fixed share of all shards, so that growth does not narrow the search.

Centroids are fitted on a sample of at most SAMPLE rows; every row is indexed. There are
about sqrt(rows) / SPREAD shards. A task holds at most about MEMBERS rows of a shard, all
parts of which are searched, and ASKING queries.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.session import cut

SAMPLE, SPREAD, MEMBERS, ASKING = 20_000, 8, 20_000, 50_000
#: Shards of all that are searched for a vector without a least similarity, and no fewer than LEAST_PROBES.
SHARE, LEAST_PROBES = 0.27, 3
SIGMAS = 2.0
#: By how much single precision can move a cosine, and more; candidates that a shard gives beyond k.
SINGLE, SPARE = 1e-6, 3


def usable(rows: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(id, v): rows with ``dims`` finite entries that aren't all zero.

    Null ids, null vectors, other lengths, NaN or infinite entries are left out. Rows may repeat.
    """
    d = rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == dims))
    top, low = F.array_max("v"), F.array_min("v")
    return d.filter((top < float("inf")) & (low > float("-inf")) & ((top > 0) | (low < 0)) & F.forall("v", lambda x: x.isNotNull()))


def _fit(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        a = np.argmax(x @ c.T, 1)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        n = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(n > 0, s / np.maximum(n, 1e-30), c).astype("f4")
    return c


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Kinds of packed rows: whole numbers over a power of ten, or floats.
_POWERS, _F4, _F8 = 10, 254, 255


def pack(x: np.ndarray) -> list[bytes]:
    """Rows of doubles in the fewest bytes an entry that give them back exactly.

    Decimals of up to nine places become whole numbers of two or four bytes, what single
    precision holds takes four, the rest eight. The first byte says which.
    """
    out: list[bytes] = [b""] * len(x)
    left = np.arange(len(x))

    def done(ok: np.ndarray, values: np.ndarray, kind: int, to: str) -> None:
        nonlocal left
        for i, r in zip(left[ok], values[ok].astype(to)):
            out[i] = bytes([kind]) + r.tobytes()
        left = left[~ok]

    for e in range(_POWERS):
        with np.errstate(over="ignore", invalid="ignore"):
            m = np.rint(x[left] * 10.0**e)
            same, top = (m / 10.0**e == x[left]).all(1), np.abs(m).max(1, initial=0)
        short = same & (top < 2**15)
        done(short, m, e, "<i2")
        m, same, top = m[~short], same[~short], top[~short]
        done(same & (top < 2**31), m, _POWERS + e, "<i4")
        if not len(left):
            return out
    with np.errstate(over="ignore"):
        f = x[left].astype("f4")
    done((f == x[left]).all(1), f, _F4, "<f4")
    done(np.ones(len(left), bool), x[left], _F8, "<f8")
    return out


def unpack(rows: Sequence[bytes]) -> np.ndarray:
    kinds = np.array([r[0] for r in rows], "u1")
    out = None
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        to = {_F4: "<f4", _F8: "<f8"}.get(int(kind), "<i2" if kind < _POWERS else "<i4")
        x = np.frombuffer(b"".join(rows[i][1:] for i in at), to).reshape(len(at), -1).astype("f8")
        if kind < _F4:
            x = x / 10.0 ** (int(kind) % _POWERS)
        out = np.empty((len(rows), x.shape[1])) if out is None else out
        out[at] = x
    return np.empty((0, 0)) if out is None else out


def _routes(x: np.ndarray, centres: np.ndarray, probes: int | None, at_least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home shard of each row; (row, shard) to search: ``probes`` nearest, else those that ``at_least`` leaves possible."""
    s = x @ centres.T
    home = np.argmax(s, 1)
    if probes is not None:
        m = min(probes, len(centres))
        near = np.argsort(-s, 1, "stable")[:, :m]
        return home, np.repeat(np.arange(len(x)), m), near.ravel()
    t = min(1.0, max(1e-6, at_least))
    apart = np.sqrt(np.maximum(0, (centres**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * centres @ centres.T))
    slack = SIGMAS * math.sqrt(1 - t * t) / t / math.sqrt(x.shape[1]) * apart[home]
    row, shard = np.nonzero(s >= s[np.arange(len(x)), home][:, None] - slack)
    return home, row, shard


def similar(vectors: DataFrame, k: int = 5, probes: int | None = None, ef: int = 16, degree: int = 16, at_least: float | None = None, shards: int | None = None) -> DataFrame:
    """The k most similar other vectors of each one.

    ``vectors``: id (string or long), v, as from ``usable``. Gives id, other, similarity
    (cosine), rank from 1; ties go to the smaller id, and only those not below ``at_least``
    are listed if it is given. Repeated rows count once; an id with several different
    vectors gets a list for each. Ids with equal vectors are kept once in the graphs; each
    of them lists its equals first. An empty table gives no rows.

    Vectors travel without loss (``pack``), are searched for in single precision, and what a
    shard finds is scored again in double precision before it is ranked or held against
    ``at_least``. ``shards`` and ``probes`` override the numbers described above.
    """
    names = vectors.select("id", F.xxhash64("v").alias("same"))
    # copies: the k + 1 smallest ids of a vector are all that anyone's list can need
    few = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    d = cut(names.distinct())
    one = d.groupBy("same", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(few(F.collect_set("id")).alias("ids"))
    reps = cut(one.groupBy("same").agg(few(F.flatten(F.collect_list("ids"))).alias("ids")))
    n = reps.count()
    if not n:
        return d.select("id", F.col("id").alias("other"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    shards = shards or max(1, math.ceil(math.sqrt(n) / SPREAD))
    step = max(1, n // SAMPLE) if n >= 1000 else 1
    sample = vectors.filter(F.pmod(F.xxhash64("v"), F.lit(step)) == 0).select("v").limit(SAMPLE).toPandas()["v"]
    sample = _unit(np.array(sample.tolist(), "f8")).astype("f4")
    centres = _fit(sample, shards)
    shards = len(centres)
    if probes is None and at_least is None:
        probes = max(LEAST_PROBES, math.ceil(SHARE * shards))
    # how often shards are home and asked, as the sample has it: large ones are split
    home, _, asked = _routes(sample, centres, probes, at_least)
    scale = n / max(1, len(sample))
    parts = {int(c): math.ceil(m * scale / MEMBERS) for c, m in zip(*np.unique(home, return_counts=True))}
    chunks = {int(c): math.ceil(m * scale / ASKING) for c, m in zip(*np.unique(asked, return_counts=True))}
    send = vectors.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        c, had = send.value, set()
        for b in batches:
            # a vector that this task had is dropped here, so copies of a hot one stay few
            fresh = [s not in had and not had.add(s) for s in b["same"]]
            b = b[fresh]
            if not len(b):
                continue
            x = np.array(b["v"].tolist(), "f8")
            home, row, shard = _routes(_unit(x).astype("f4"), c, probes, at_least)
            raw = pack(x)
            yield pd.DataFrame({"same": b["same"].to_numpy()[row], "shard": shard.astype("i4"), "home": shard == home[row], "x": [raw[i] for i in row]})

    placed = vectors.select(F.xxhash64("v").alias("same"), "v").mapInPandas(assign, "same long, shard int, home boolean, x binary")

    def per_shard(m: dict[int, int]):
        large = [F.lit(x) for shard, p in m.items() if p > 1 for x in (shard, p)]
        return F.coalesce(F.create_map(*large)[F.col("shard")], F.lit(1)) if large else F.lit(1)

    up_to = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    placed = placed.withColumns({"parts": per_shard(parts), "chunks": per_shard(chunks)})
    placed = placed.withColumns({"mine": F.pmod("same", F.col("parts")).cast("int"), "turn": F.pmod(F.xxhash64("same"), F.col("chunks")).cast("int")})
    # members go to every chunk of their part, and ask in one; others ask in every part
    member = F.transform(up_to("chunks"), lambda c: F.struct(F.col("mine").alias("part"), c.alias("chunk"), F.lit(True).alias("member"), (c == F.col("turn")).alias("ask")))
    asking = F.transform(F.filter(up_to("parts"), lambda p: ~F.col("home") | (p != F.col("mine"))), lambda p: F.struct(p.alias("part"), F.col("turn").alias("chunk"), F.lit(False).alias("member"), F.lit(True).alias("ask")))
    own = placed.select("same", "shard", "x", F.explode(F.concat(F.when(F.col("home"), member).otherwise(F.array()), asking)).alias("to")).select("same", "shard", "x", "to.*")

    # what is below isn't listed, and can't move what is above: it needn't travel
    floor = -2.0 if at_least is None else at_least - SINGLE
    nothing = pd.DataFrame({"same": np.empty(0, "i8"), "near": pd.Series([], dtype=object), "sims": pd.Series([], dtype=object)})

    def search(g: pd.DataFrame) -> pd.DataFrame:
        from repolith.llm.hnsw import Graph

        g = g.sort_values("same", kind="stable").drop_duplicates("same")  # hashes: a random order, the same on every attempt
        x = _unit(unpack(g["x"].tolist()))
        home, ask, same = g["member"].to_numpy(bool), g["ask"].to_numpy(bool), g["same"].to_numpy()
        if not home.any() or not ask.any():
            return nothing
        full, mine = x[home], same[home]
        x, same = x[ask], same[ask]
        ids, s = Graph.build(full.astype("f4"), degree, 2 * ef).search(x.astype("f4"), k + 1 + SPARE, ef)
        ok = (ids >= 0) & (s >= floor) & (mine[ids] != same[:, None])
        some = np.flatnonzero(ok.any(1))
        rows_near, rows_s = [], []
        for i in range(0, len(some), 4096):
            at = some[i : i + 4096]
            exact = np.einsum("ij,ikj->ik", x[at], full[ids[at]])
            for near, sims, keep in zip(mine[ids[at]], exact, ok[at]):
                rows_near.append(near[keep].tolist())
                rows_s.append(sims[keep].tolist())
        return pd.DataFrame({"same": same[some], "near": rows_near, "sims": rows_s}) if len(some) else nothing

    found = own.groupBy("shard", "part", "chunk").applyInPandas(search, "same long, near array<long>, sims array<double>")
    pairs = found.filter(F.size("near") > 0).select("same", F.explode(F.arrays_zip("sims", "near")).alias("p"))
    best = pairs.groupBy("same").agg(F.slice(F.reverse(F.array_sort(F.collect_set("p"))), 1, 2 * k).alias("p"))
    best = best.select("same", F.explode("p").alias("p")).select("same", F.col("p.near").alias("near"), F.col("p.sims").alias("similarity"))
    best = best if at_least is None else best.filter(F.col("similarity") >= at_least)
    other = best.join(reps.withColumnsRenamed({"same": "near", "ids": "others"}), "near").select("same", "similarity", F.explode(F.slice("others", 1, k)).alias("other"))
    equal = reps.filter(F.size("ids") > 1).select("same", F.lit(1.0).alias("similarity"), F.explode("ids").alias("other"))
    lists = other.unionByName(equal).groupBy("same").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("other")))).alias("l"))
    out = d.join(lists, "same").select("id", F.posexplode(F.slice(F.filter("l", lambda x: x["other"] != F.col("id")), 1, k)).alias("r", "p"))
    return out.select("id", F.col("p.other").alias("other"), (-F.col("p.s")).alias("similarity"), (F.col("r") + 1).alias("rank"))
