"""Evaluation passages inside training documents: a prefix-filtered set join on word shingles.

A window of ``span`` item words is the set of its shingles. A document that contains the
window contains each of them, so its rarest shingle is the one token that must be joined
(the prefix, for an overlap of the whole set). Position and length bounds follow from the
place of the shingle in the window; the words themselves decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.session import cut

#: Item shingles (16 bytes each) up to which they are sent to every executor.
BROADCAST_ROWS = 1_000_000


def words(c: Column | str) -> Column:
    """Maximal runs of letters and digits in lower case; null gives none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingled(d: DataFrame, key: str, k: int) -> DataFrame:
    """(key, pos, h): the hash of k words from each position on."""
    at = F.explode(F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k)))
    return d.select(key, "w", at.alias("pos")).select(key, "pos", F.xxhash64(*[F.get("w", F.col("pos") + i) for i in range(k)]).alias("h"))


def leaked(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, span: int = 12, k: int = 5) -> DataFrame:
    """Distinct (doc_key, item_key) where the document has ``span`` successive words of the item.

    Items of fewer words, null or empty texts match nothing; the same text under two item
    ids matches under both. Null keys are dropped.
    """
    it = cut(items.select(F.col(item_key).alias("item"), words(item_text).alias("w")).dropna().filter(F.size("w") >= span).distinct())
    ish = cut(_shingled(it, "item", k))
    probe = ish.select("h").distinct()
    if ish.count() <= BROADCAST_ROWS:
        probe = F.broadcast(probe)
    d = docs.select(F.col(doc_key).alias("doc"), words(doc_text).alias("w")).filter("doc is not null")
    hits = cut(_shingled(d, "doc", k).join(probe, "h"))
    df = hits.groupBy("h").agg(F.count_distinct("doc").alias("df"))
    # the rarest shingle of each window; a window with one that no document has needs no join
    inside = F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - (span - k)), F.col("pos")))
    last = it.select("item", F.size("w").alias("len"))
    per = ish.join(df, "h", "left").select("item", "pos", "h", F.coalesce("df", F.lit(0)).alias("df"), inside.alias("start")).join(last, "item").filter(F.col("start") + span <= F.col("len"))
    rare = per.groupBy("item", "start").agg(F.min(F.struct("df", "pos", "h")).alias("x")).filter("x.df > 0").select("item", "start", F.col("x.pos").alias("ipos"), F.col("x.h").alias("h"))
    cand = hits.join(rare, "h").select("doc", "item", "start", (F.col("pos") - F.col("ipos") + F.col("start")).alias("at")).filter("at >= 0")
    cand = cand.join(it.withColumnRenamed("w", "iw"), "item").select("doc", "item", "at", F.slice("iw", F.col("start") + 1, F.lit(span)).alias("want"))
    full = docs.select(F.col(doc_key).alias("doc"), doc_text).join(cand.select("doc").distinct(), "doc", "left_semi").select("doc", words(doc_text).alias("w"))
    ok = cand.join(full, "doc").filter((F.col("at") + span <= F.size("w")) & (F.slice("w", F.col("at") + 1, F.lit(span)) == F.col("want")))
    return ok.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key)).distinct()
