"""Text search: tokens, hashed TF-IDF vectors, lexical and semantic ranking, rank fusion."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that are no search terms.
STOPWORDS = (
    "a an and are as at be by const class def enum export file for from function if implements import in interface is it let module new of on or "
    "public private protected return static struct the this to type var void with"
).split()
DIMENSIONS, RRF = 96, 60


def tokens(c: Column | str) -> Column:
    """Search terms in order: camel case split, lower case, at least two characters, no stop words; null gives none."""
    c = F.col(c) if isinstance(c, str) else c
    flat = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2"))
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.split(flat, r"[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def tokens_of(text: str) -> list[str]:
    """``tokens`` for a driver-side string, such as a query."""
    flat = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text or "").lower()
    return [t for t in re.split(r"[^a-z0-9]+", flat) if len(t) >= 2 and t not in STOPWORDS]


def rolling_hash(token: Column) -> Column:
    """The 32-bit hash h = 31 h + c with wrap-around, as a signed long. ASCII only, as ``tokens`` are."""
    wrap = lambda h, c: F.pmod(h * 31 + F.ascii(c).cast("long") + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    return F.aggregate(F.split(token, ""), F.lit(0).cast("long"), wrap)


def hash_of(token: str) -> int:
    h = 0
    for c in token:
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    return h


def _weighted(docs: DataFrame, key: str, text: str, per_token: list[Column]) -> DataFrame:
    """(key, token, weight) and what ``per_token`` makes of each distinct token."""
    t = docs.select(key, F.explode(tokens(text)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    df = t.groupBy("token").agg(F.count("*").alias("df")).select("*", *per_token)
    total = docs.count()
    w = (F.log("n") + 1) * (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1)
    return t.join(df, "token").withColumn("weight", w).drop("n", "df")


def term_weights(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, weight): tf 1 + ln n times idf ln((N + 1) / (df + 1)) + 1."""
    return _weighted(docs, key, text, []).select(key, "token", "weight")


def hashed_vectors(docs: DataFrame, key: str, text: str, dims: int = DIMENSIONS) -> DataFrame:
    """(key, idx, value): nonzero entries of the normalised hashed vectors. Texts without terms have none.

    A token is hashed once, however many documents have it; a document's entries are summed
    and normalised in one partition.
    """
    w = _weighted(docs, key, text, [rolling_hash(F.col("token")).alias("h")])
    part = F.col("weight") * F.when(F.col("h") % 2 == 0, 1.0).otherwise(-1.0)
    v = w.select(key, (F.abs("h") % dims).alias("idx"), part.alias("part")).repartition(key).groupBy(key, "idx").agg(F.sum("part").alias("value"))
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(key)))
    return v.select(key, "idx", F.try_divide("value", norm).alias("value")).filter("value <> 0")


def query_vector(text: str, dims: int = DIMENSIONS) -> dict[int, float]:
    """A query's hashed vector, with idf 1."""
    terms = tokens_of(text)
    v: dict[int, float] = {}
    for t in dict.fromkeys(terms):
        h = hash_of(t)
        v[abs(h) % dims] = v.get(abs(h) % dims, 0.0) + (1 + math.log(terms.count(t))) * (1 if h % 2 == 0 else -1)
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {i: x / norm for i, x in v.items()} if norm else {}


def lexical(docs: DataFrame, key: str, text: str, queries: list[str]) -> DataFrame:
    """(query, key, score): share of query terms found as part of a term, 0.25 more for the whole phrase; only scores above 0.

    ``queries`` is a stated list; each document is scored for all of them in one pass.
    """
    d = docs.select(key, F.array_join(tokens(text), " ").alias("hay"))
    scored = []
    for q in queries:
        terms = tokens_of(q)
        if not terms:
            continue
        hits = sum((F.contains("hay", F.lit(t)).cast("int") for t in terms), F.lit(0))
        phrase = F.when(F.contains(F.col("hay"), F.lit(" ".join(terms))), 0.25).otherwise(0.0)
        scored.append(F.struct(F.lit(q).alias("query"), (phrase + hits / F.lit(float(len(terms)))).alias("score")))
    if not scored:
        return d.select(F.lit("").alias("query"), key, F.lit(0.0).alias("score")).limit(0)
    return d.select(key, F.explode(F.array(*scored)).alias("s")).select("s.query", key, "s.score").filter("score > 0")


def semantic(vectors: DataFrame, key: str, queries: list[str], dims: int = DIMENSIONS) -> DataFrame:
    """(query, key, score): cosine of hashed vectors, only above 0."""
    spark = vectors.sparkSession
    rows = [(q, i, x) for q in queries for i, x in query_vector(q, dims).items()]
    q = spark.createDataFrame(rows, "query string, idx long, x double")  # as many rows as the stated queries have terms
    return vectors.join(F.broadcast(q), "idx").groupBy("query", key).agg(F.sum(F.col("value") * F.col("x")).alias("score")).filter("score > 0")


def fused(lists: list[DataFrame], key: str, k: int, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of (query, key, score) lists: the top 4k of each, then the k best (query, key, score, rank)."""
    parts = []
    for d in lists:
        r = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), key))
        parts.append(d.withColumn("r", r).filter(F.col("r") <= 4 * k).select("query", key, (F.lit(1.0) / (F.col("r") + constant)).alias("gain")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy("query", key).agg(F.sum("gain").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), key))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def hybrid(docs: DataFrame, key: str, text: str, queries: list[str], k: int = 10, vectors: DataFrame | None = None) -> DataFrame:
    """Lexical and semantic ranking fused. ``vectors`` is a kept index (``store.read_index``); without one they are made."""
    vectors = hashed_vectors(docs, key, text) if vectors is None else vectors
    return fused([lexical(docs, key, text, queries), semantic(vectors, key, queries)], key, k)
