"""Items that occur together in baskets, with exact counts and their surprise.

``all_pairs`` counts what the tests against the null need. Where thresholds alone are asked for,
``pair_counts`` takes candidates from a prefix filter instead of all pairs of a basket. A pair that
reaches the thresholds shares at least ``need`` baskets of its rarer item; put the rarer
item's baskets in order of size, and two of the shared ones lie among the first
``n - need + 2``. So large baskets serve for counting only, never for pairing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.operators.ordered import fits, neighbours
from repolith.session import cut

#: Rows of a group that one task pairs; larger groups are split by a salt of the basket.
SPLIT = 200_000


def incidence(rows: DataFrame, group: str, basket: str, item: str) -> DataFrame:
    """Distinct (g, b, i) as 64-bit keys within a group; rows with a null are dropped."""
    d = rows.select(F.col(group).alias("g0"), F.col(basket).alias("b0"), F.col(item).alias("i0")).dropna()
    return d.select(F.xxhash64("g0").alias("g"), F.xxhash64("b0").alias("b"), F.xxhash64("i0").alias("i")).distinct()


def frequencies(inc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per item its number of baskets ``n``; per group its number of baskets ``total``."""
    n = inc.groupBy("g", "i").agg(F.count(F.lit(1)).alias("n"))
    total = inc.select("g", "b").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("total"))
    return n, total


def pair_counts(inc: DataFrame, min_count: int = 4, min_ratio: float = 0.5, min_lift: float = 2.0) -> DataFrame:
    """All pairs of a group's items that reach the thresholds, with exact counts.

    ``inc`` is an ``incidence`` (read several times: a written or cut one). ``min_count`` is
    at least 2. Gives g, i, j (keys, i the rarer), n_i, n_j, c, total. Empty input gives no rows.
    """
    n, total = frequencies(inc)
    # a pair's count is at most that of its rarer item, so n of either is at most total / lift
    n = n.join(total, "g").filter((F.col("n") >= min_count) & (F.col("n") * min_lift <= F.col("total")))
    e = inc.join(n, ["g", "i"]).withColumn("rows_g", F.lit(0)).drop("rows_g")
    e = cut(e.repartition("g", "b").withColumn("s", F.count(F.lit(1)).over(Window.partitionBy("g", "b"))).filter("s > 1"))
    need = F.greatest(F.lit(min_count), F.ceil(F.col("n") * min_ratio - 1e-9), F.ceil(F.col("n") * F.col("n") * min_lift / F.col("total") - 1e-9)).cast("int")
    split = e.groupBy("g").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / SPLIT)).cast("int").alias("parts"))
    rank = F.row_number().over(Window.partitionBy("g", "i").orderBy("s", "b"))
    placed = e.join(split, "g").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    ranked = placed.withColumn("rank", rank).withColumn("need", need)
    head = ranked.filter("rank <= n - need + 2").repartition("g", "salt")
    other = placed.select("g", "salt", "b", F.col("i").alias("j"), F.col("n").alias("n_j")).repartition("g", "salt")
    pairs = head.join(other.hint("shuffle_hash"), ["g", "salt", "b"]).filter("n < n_j or (n = n_j and i < j)")
    seen = pairs.groupBy("g", "i", "j").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n_i"), F.first("n_j").alias("n_j"), F.first("need").alias("need"), F.first("total").alias("total"))
    # the pair's own bound by the lift is sharper than the item's
    own = F.greatest(F.col("need"), F.ceil(F.col("n_i") * F.col("n_j") * min_lift / F.col("total") - 1e-9))
    seen = cut(seen.filter("k >= 2").withColumn("need", own.cast("int")).filter("need <= n_i and k + n_i >= need"))
    # the rest of the rarer item's baskets decides
    tail = ranked.filter("rank > n - need + 2").select("g", "i", "b")
    more = seen.select("g", "i", "j").join(tail, ["g", "i"]).join(e.select("g", "b", F.col("i").alias("j")), ["g", "b", "j"], "left_semi")
    more = more.groupBy("g", "i", "j").agg(F.count(F.lit(1)).alias("m"))
    out = seen.join(more, ["g", "i", "j"], "left").withColumn("c", F.col("k") + F.coalesce("m", F.lit(0)))
    out = out.filter((F.col("c") >= min_count) & (F.col("c") >= F.col("n_i") * min_ratio) & (F.col("c") * F.col("total") >= F.col("n_i") * F.col("n_j") * min_lift))
    return out.select("g", "i", "j", "n_i", "n_j", "c", "total")


def all_pairs(inc: DataFrame) -> DataFrame:
    """Every two items of a group that occur together, with exact counts; columns as of ``pair_counts``.

    Baskets spread over the tasks, whatever the group, and each counts its pairs before they meet.
    """
    n, total = frequencies(inc)
    e = inc.join(n, ["g", "i"])
    x, y = e.alias("x"), e.alias("y")  # of one shuffle, as both have the same columns
    pairs = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.b") == F.col("y.b"))).filter("x.n < y.n or (x.n = y.n and x.i < y.i)")
    c = pairs.groupBy("x.g", "x.i", F.col("y.i").alias("j")).agg(F.first("x.n").alias("n_i"), F.first("y.n").alias("n_j"), F.count(F.lit(1)).alias("c"))
    return c.join(total, "g").select("g", "i", "j", "n_i", "n_j", "c", "total")


# --- the null: a bipartite configuration model that honours item frequency and basket size


def _fit(d: pd.DataFrame) -> pd.DataFrame:
    """Fitness of the degree classes of one group; d: side (0 item, 1 basket), degree, many.

    ``off`` is the largest relative error of an expected degree: above 1e-6 the rounds didn't suffice.
    """
    a, b = d[d["side"] == 0], d[d["side"] == 1]
    k, mk, s, ms = (x.to_numpy(float) for x in (a["degree"], a["many"], b["degree"], b["many"]))
    edges = max(1.0, float(k @ mk))
    x, y = k / np.sqrt(edges), s / np.sqrt(edges)
    off = 0.0
    for _ in range(500):
        y = s / np.maximum(1e-300, (mk * x / (1 + np.outer(y, x))).sum(1))
        nx = k / np.maximum(1e-300, (ms * y / (1 + np.outer(x, y))).sum(1))
        off, x = np.max(np.abs(nx - x) / np.maximum(x, 1e-300), initial=0.0), nx
        if off < 1e-9:
            break
    return pd.concat([a, b]).assign(fit=np.r_[x, y], off=off)


def degree_class(n: Column) -> Column:
    """Class of a frequency or size: itself below 64, then 64 classes for every doubling (at most 1.6 % wide)."""
    e = F.greatest(F.lit(0), F.floor(F.log2(n.cast("double")) + 1e-12).cast("int") - 6)
    return F.when(n < 64, n).otherwise(F.lit(64) * e + F.floor(n / F.pow(F.lit(2.0), e))).cast("int")


def null_model(inc: DataFrame) -> DataFrame:
    """Fitted classes (g, side, class, degree, many, fit, off): P(item of degree k in basket of size s) = xy / (1 + xy).

    Frequencies and sizes are grouped by ``degree_class`` at their mean, so a group has no
    more than about 1,600 classes a side whatever its rows, and its fit holds only these.
    """
    side = lambda by, s: inc.groupBy("g", by).agg(F.count(F.lit(1)).alias("n")).groupBy("g", degree_class(F.col("n")).alias("class")).agg(F.avg("n").alias("degree"), F.count(F.lit(1)).alias("many")).withColumn("side", F.lit(s))
    d = side("i", 0).unionByName(side("b", 1)).select("g", "side", "class", "degree", "many")
    return d.groupBy("g").applyInPandas(_fit, "g long, side int, class int, degree double, many long, fit double, off double")


def poisson_binomial_tail(p: np.ndarray, many: np.ndarray, c: int) -> float:
    """P(X >= c), X the number of successes over many[s] trials of chance p[s] each."""
    if c <= 0:
        return 1.0
    mean = float(p @ many)
    size = c + 40 + int(4 * np.sqrt(mean) + (mean if mean > c else 0))
    pmf = np.zeros(size + 1)
    pmf[0] = 1.0
    for q, m in zip(p, many):
        q, m = min(float(q), 1 - 1e-12), int(m)
        if q <= 0:
            continue
        top = min(m, size)
        r = np.arange(1, top + 1)
        one = np.exp(m * np.log1p(-q) + np.r_[0.0, np.cumsum(np.log((m - r + 1) / r) + np.log(q) - np.log1p(-q))])
        pmf = np.convolve(pmf, one)[: size + 1]
    upper = float(pmf[c:].sum())
    # a tail that isn't small is surer from below
    return min(1.0, upper if upper < 0.5 and mean <= c else max(0.0, 1.0 - float(pmf[:c].sum())))


def upper_tails(p: np.ndarray, many: np.ndarray, c: np.ndarray) -> np.ndarray:
    """P(X_r >= c_r) for each row r of chances, X_r the successes over many[s] trials of p[r, s].

    For c above one each law is tilted until its mean is c (Newton), then inverted from its characteristic
    function on as many points as its tail needs, so even tiny tails keep their relative precision.
    """
    p, c = np.clip(p, 1e-300, 1 - 1e-12), np.asarray(c, float)
    out = np.ones(len(c))
    mean = p @ many
    far = np.flatnonzero((c > 1) & (c <= many.sum()))
    out[c > many.sum()] = 0.0
    # one success or more: all but none
    once = (c > 0) & (c <= 1) & (c <= many.sum())
    out[once] = -np.expm1(np.log1p(-p[once]) @ many)
    if not len(far):
        return out
    odds = p[far] / (1 - p[far])
    goal, trials = np.minimum(c[far], many.sum() - 0.5), many.sum()
    t = np.where(goal > mean[far], np.log(goal * (trials - np.minimum(mean[far], trials - 1e-9)) / np.maximum(1e-300, mean[far] * (trials - goal))), 0.0)
    for _ in range(60):
        q = odds * np.exp(t)[:, None]
        q = q / (1 + q)
        m, v = q @ many, (q * (1 - q)) @ many
        step = np.where(goal > mean[far], (goal - m) / np.maximum(v, 1e-12), -t)
        t = t + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    q = odds * np.exp(t)[:, None]
    q = q / (1 + q)
    m, sd = q @ many, np.sqrt((q * (1 - q)) @ many)
    # log of the moment generating function at t
    log_k = (np.log1p(p[far] * np.expm1(t)[:, None])) @ many
    points = 2 ** np.ceil(np.log2(np.maximum(m, c[far]) + 12 * sd + 48)).astype(int)
    for n in np.unique(points):
        at = np.flatnonzero(points == n)
        for i in range(0, len(at), max(1, 2**21 // (n * len(many)))):
            r = at[i : i + max(1, 2**21 // (n * len(many)))]
            w = np.exp(-2j * np.pi * np.arange(n // 2 + 1) / n) - 1
            phi = np.exp(np.log1p(q[r][:, :, None] * w).transpose(0, 2, 1) @ many)
            pmf = np.maximum(0.0, np.fft.irfft(phi, n, axis=1))
            beyond = np.arange(n) - c[far][r][:, None]
            tail = np.where(beyond >= 0, pmf * np.exp(-t[r][:, None] * np.maximum(0, beyond)), 0.0).sum(1)
            out[far[r]] = np.minimum(1.0, np.exp(log_k[r] - t[r] * c[far][r]) * tail)
    return out


#: Cases that one task holds against the null of their group.
CASES = 20_000


def _held_against(cases: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    x = model[model["side"] == 0].set_index("class")["fit"]
    y = model[model["side"] == 1]
    fits, many = y["fit"].to_numpy(), y["many"].to_numpy(float)
    out = cases[["g", "ki", "kj", "c"]].copy()
    mean, tail = np.empty(len(out)), np.empty(len(out))
    for i in range(0, len(out), 1024):
        part = out.iloc[i : i + 1024]
        a, b = (x.loc[part[k]].to_numpy()[:, None] * fits for k in ("ki", "kj"))
        p = a / (1 + a) * (b / (1 + b))
        mean[i : i + 1024], tail[i : i + 1024] = p @ many, upper_tails(p, many, part["c"].to_numpy())
    return out.assign(expected=mean, p_value=tail)


def against_null(inc: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` with the degree classes ki, kj of their items; and for each case (g, ki, kj, c) of
    them the number of its pairs, the count expected under ``null_model`` and the Poisson-binomial
    p value. Cases of a group are spread over tasks of at most about CASES.
    """
    model = cut(null_model(inc))
    d = pairs.withColumns({"ki": degree_class(F.col("n_i")), "kj": degree_class(F.col("n_j"))})
    cases = cut(d.groupBy("g", "ki", "kj", "c").agg(F.count(F.lit(1)).alias("pairs")))
    parts = cases.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / CASES).cast("int").alias("parts"))
    placed = cases.join(parts, "g").withColumn("part", F.pmod(F.xxhash64("ki", "kj", "c"), F.col("parts")).cast("int")).drop("parts")
    models = model.join(parts, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = placed.groupBy("g", "part").cogroup(models.groupBy("g", "part")).applyInPandas(_held_against, "g long, ki int, kj int, c long, expected double, p_value double")
    return d, held.join(cases, ["g", "ki", "kj", "c"])


def surprise(inc: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add ``expected``, p and q values to ``all_pairs`` (or a part of them).

    The p value is the Poisson-binomial tail of the count under ``null_model``; q is the
    Benjamini-Hochberg value over all pairs of the group's items. Pairs not given count as
    tests of p = 1, which holds for ``all_pairs``: what isn't listed there never meets. For a
    part of them q is an upper bound only. Ranks are taken over the distinct cases.
    """
    d, cases = against_null(inc, pairs)
    m = inc.select("g", "i").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("items")).select("g", (F.col("items") * (F.col("items") - 1) / 2).alias("tests"))
    by, bucket = ["p_value", "ki", "kj", "c"], F.floor(F.greatest(F.lit(-700.0), F.log(F.greatest("p_value", F.lit(1e-300)))))
    cases = cut(cases.join(m, "g"))
    whole = fits(cases, ["g"])
    cases = neighbours(cases, ["g"], by, bucket, up_to_sum=["pairs"], whole=whole)
    cases = cases.withColumn("q_raw", F.least(F.lit(1.0), F.col("p_value") * F.col("tests") / F.col("sum_upto_pairs")))
    # the least of a case and all after it, in reverse: a frame that ends with the group is added up anew for every row
    reverse = {f"from_{c}": -F.col(c) for c in [*by, "q_raw"]}
    cases = neighbours(cases.withColumns(reverse), ["g"], [f"from_{c}" for c in by], -bucket, up_to_max=["from_q_raw"], whole=whole)
    cases = cases.select("g", "ki", "kj", "c", "expected", "p_value", (-F.col("max_upto_from_q_raw")).alias("q_value"))
    return d.join(cases, ["g", "ki", "kj", "c"]).drop("ki", "kj")


def names(rows: DataFrame, pairs: DataFrame, group: str, item: str) -> DataFrame:
    """Give pairs their strings again: ``group``, a, b with a < b (bytes)."""
    d = rows.select(F.col(group).alias("gname"), F.col(item).alias("iname")).dropna().distinct().withColumns({"g": F.xxhash64("gname"), "k": F.xxhash64("iname")})
    out = pairs.join(d.select("g", F.col("k").alias("i"), F.col("iname").alias("ni"), "gname"), ["g", "i"]).join(d.select("g", F.col("k").alias("j"), F.col("iname").alias("nj")), ["g", "j"])
    return out.withColumns({"a": F.least("ni", "nj"), "b": F.greatest("ni", "nj"), group: F.col("gname")}).drop("ni", "nj", "gname", "g", "i", "j")
