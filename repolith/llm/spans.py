"""Long exact spans that several documents share.

1. Fingerprints: in every window of ``span`` characters the smallest hash of GRAM
   characters is an anchor, so two documents with a common span share an anchor at the
   same place of it. Around each anchor, passages of ``span - STEP`` characters on a grid
   are hashed; a common span contains the same passage in both documents.
2. Passages that recur are confirmed, as hashes without places. Documents go on with the
   hashes they hold, in blocks; each recurring passage of a block is cut from one holder,
   passages are compiled into sharded Aho-Corasick automata, and all the block's documents
   are streamed through these, which alone say where passages occur. A document without a recurring
   passage can hold no common span.
3. Each occurrence is cut finer (``span - FINE`` characters) and keeps FINE characters of
   context on either side, which decide exactly whether ``span`` characters agree.

Nothing is paired before it shares ``span - FINE`` characters. Copies of a text are
represented by one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.session import cut

GRAM, STEP, FINE = 32, 64, 8
#: Characters hashed at once; leading characters of a passage in an automaton, and passages of one.
CHUNK, LEAD, SHARD = 1 << 21, 64, 8000
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and its inverse, kept per worker."""

    up: np.ndarray | None = None
    down: np.ndarray | None = None

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up is None or len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_inverse(_BASE), n)
        return cls.up, cls.down


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of a[i : i + width] for each i where it fits."""
    m, have = a, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def passages(texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which text, hash of the passage, its start in the text) of texts of at least ``span`` characters."""
    sizes = np.array([len(t) for t in texts], "i8")
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    c = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype("u8") * np.uint64(_MIX) + np.uint64(0x632BE59BD9B4E019)
    n = len(c)
    up, down = _Powers.get(n + 1)
    with np.errstate(over="ignore"):
        h, have, base = c, 1, _BASE
        while have < GRAM:
            h = h[:-have] * np.uint64(base) + h[have:]
            base, have = base * base % (1 << 64), have * 2
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX)
        h ^= h >> np.uint64(32)
        low = np.uint64((1 << 24) - 1)
        key = (h * np.uint64(_BASE) & ~low) | np.arange(len(h), dtype="u8")
        anchor = (_sliding_min(key, span - GRAM + 1) & low).astype("i8")
        inside = np.zeros(n + 1, "i4")
        np.add.at(inside, first, 1)
        np.add.at(inside, first + sizes - span + 1, -1)
        starts = np.flatnonzero(np.cumsum(inside)[: len(anchor)] > 0)
        at = anchor[starts]
        turn = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
        p, s_lo, s_hi = at[turn], starts[turn], starts[np.r_[turn[1:] - 1, len(starts) - 1]]
        g_lo, g_hi = (p - s_hi) // STEP, (p - s_lo) // STEP
        many = g_hi - g_lo + 1
        which = np.repeat(np.arange(len(p)), many)
        g = g_lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        a = p[which] - g * STEP
        b = a + span - STEP
        total = np.r_[np.uint64(0), np.cumsum(c * up[:n])]
        x = (total[b] - total[a]) * down[a]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX)
    text = np.searchsorted(first, a, "right") - 1
    return text, (x ^ (x >> np.uint64(32))).view("i8"), (a - first[text]).astype("i4")


def _hashed(texts: list[str], span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, which of those after it, hash, start) of at most about CHUNK characters at a time."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK or i == len(texts) - 1:
            yield at, *passages(texts[at : i + 1], span)
            at, held = i + 1, 0


def _fingerprints(span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            docs = d["doc"].to_numpy()
            for at, which, key, _ in _hashed(d["text"].tolist(), span):
                yield pd.DataFrame({"doc": docs[at + which], "key": key}).drop_duplicates()

    return run


def locate(texts: list[str], phrases: list[str]) -> list[set[int]]:
    """Per text where any of the phrases occurs: automata of SHARD phrases' leads, each hit compared in full."""
    found: list[set[int]] = [set() for _ in texts]
    for i in range(0, len(phrases), SHARD):
        leads: dict[str, list[str]] = {}
        for p in phrases[i : i + SHARD]:
            leads.setdefault(p[:LEAD], []).append(p)
        automaton = ahocorasick.Automaton()
        for lead, same in leads.items():
            automaton.add_word(lead, (len(lead), same))
        automaton.make_automaton()
        for k, t in enumerate(texts):
            for end, (size, same) in automaton.iter(t):
                if any(t.startswith(p, end + 1 - size) for p in same):
                    found[k].add(end + 1 - size)
    return found


def _located(span: int):
    size = span - STEP

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            docs, texts = d["doc"].tolist(), d["text"].tolist()
            wanted = np.unique(np.concatenate([np.asarray(k, "i8") for k in d["keys"]])) if len(d) else np.empty(0, "i8")
            phrases, had = [], set()
            for at, which, key, start in _hashed(texts, span):
                key, first = np.unique(key, return_index=True)
                for k, j in zip(key[np.isin(key, wanted)], first[np.isin(key, wanted)]):
                    if k not in had:  # the block's first holder says what the passage is
                        had.add(k)
                        phrases.append(texts[at + which[j]][start[j] : start[j] + size])
            fine = span - FINE
            rows = []
            for doc, t, places in zip(docs, texts, locate(texts, phrases)):
                for s in sorted({s - FINE * q for s in places for q in range(STEP // FINE + 1)}):
                    if 0 <= s and s + fine <= len(t):
                        rows.append((doc, xxhash.xxh3_128_digest(t[s : s + fine].encode()), s, t[max(0, s - FINE) : s], t[s + fine : s + span]))
            yield pd.DataFrame(rows, columns=["doc", "key", "start", "before", "after"])

    return run


def copies(docs: DataFrame, span: int) -> DataFrame:
    """(doc, rep): each document of at least ``span`` characters and the smallest id with its text."""
    d = docs.filter(F.length("text") >= span).select("doc", F.unhex(F.sha2("text", 256)).alias("digest"))
    return d.join(d.groupBy("digest").agg(F.min("doc").alias("rep")), "digest").select("doc", "rep")


def occurrences(docs: DataFrame, span: int = 400) -> tuple[DataFrame, DataFrame]:
    """Recurring fine passages (doc, key, start, before, after) of representatives, and ``copies``."""
    d = docs.filter("doc is not null and text is not null").filter(F.length("text") >= span)
    same = cut(copies(d, span))
    keys = cut(d.mapInPandas(_fingerprints(span), "doc long, key long").join(same.filter("doc <> rep").select("doc"), "doc", "left_anti"))
    twice = keys.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a <> b").select("key")
    held = keys.join(twice, "key", "left_semi").groupBy("doc").agg(F.collect_set("key").alias("keys"))
    found = d.join(held, "doc").mapInPandas(_located(span), "doc long, key binary, start int, before string, after string")
    return cut(found), same


def _agrees(x: str, y: str) -> Column:
    """FINE more characters agree around equal passages, on one side or both."""
    cases = []
    for left in range(FINE + 1):
        right = FINE - left
        a = (F.length(f"{x}.before") >= left) & (F.length(f"{y}.before") >= left) & (F.right(F.col(f"{x}.before"), F.lit(left)) == F.right(F.col(f"{y}.before"), F.lit(left))) if left else F.lit(True)
        b = (F.length(f"{x}.after") >= right) & (F.length(f"{y}.after") >= right) & (F.left(F.col(f"{x}.after"), F.lit(right)) == F.left(F.col(f"{y}.after"), F.lit(right))) if right else F.lit(True)
        cases.append(a & b)
    out = cases[0]
    for c in cases[1:]:
        out = out | c
    return out


def sharing_classes(docs: DataFrame, span: int = 400) -> tuple[DataFrame, DataFrame]:
    """Pairs (ra < rb) of different texts with ``span`` equal characters in a row, each text by the
    smallest id that has it, and the membership (doc, rep) of documents of at least ``span`` characters.

    ``docs``: doc (long, unique), text. Null ids, null and shorter texts share nothing.
    """
    found, same = occurrences(docs, span)
    x, y = found.alias("x"), found.alias("y")
    reps = x.join(y, F.expr("x.key = y.key and x.doc < y.doc")).filter(_agrees("x", "y")).select(F.col("x.doc").alias("ra"), F.col("y.doc").alias("rb")).distinct()
    return reps, same


def sharing_pairs(docs: DataFrame, span: int = 400) -> DataFrame:
    """``sharing_classes`` with copies expanded: all pairs (doc_a < doc_b)."""
    reps, same = sharing_classes(docs, span)
    twins = same.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("rep").alias("ra"), F.col("rep").alias("rb"))
    a, b = same.select(F.col("doc").alias("a"), F.col("rep").alias("ra")), same.select(F.col("doc").alias("b"), F.col("rep").alias("rb"))
    out = reps.unionByName(twins).join(a, "ra").join(b, "rb").filter("ra <> rb or a < b")
    return out.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))


def link_counts(docs: DataFrame, span: int = 400) -> DataFrame:
    """Per document of at least ``span`` characters (doc, rep, links): its class of equal texts, and with how many other documents it shares a span."""
    reps, same = sharing_classes(docs, span)
    size = same.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    reps = cut(reps)
    both = reps.select(F.col("ra").alias("rep"), F.col("rb").alias("other")).unionByName(reps.select(F.col("rb").alias("rep"), F.col("ra").alias("other")))
    linked = both.join(size.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("n").alias("linked"))
    per = size.join(linked, "rep", "left").select("rep", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    return same.join(per, "rep").select("doc", "rep", "links")


def shared_characters(docs: DataFrame, span: int = 400) -> DataFrame:
    """Per document (doc, n_chars, shared_chars): characters that lie in spans shared with another one."""
    found, same = occurrences(docs, span)
    cases = F.array(*[F.when((F.length("before") >= k) & (F.length("after") >= FINE - k), F.struct((F.col("start") - k).alias("at"), F.concat(F.right("before", F.lit(k)) if k else F.lit(""), F.lit("|"), F.left("after", F.lit(FINE - k)) if k < FINE else F.lit("")).alias("ctx"))) for k in range(FINE + 1)])
    win = found.select("doc", "key", F.explode(cases).alias("w")).filter("w is not null").select("doc", F.xxhash64("key", "w.ctx").alias("h"), F.hash("w.ctx", "key").alias("h2"), "w.at")
    multi = win.groupBy("h", "h2").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a <> b").select("h", "h2")
    mine = win.join(multi, ["h", "h2"], "left_semi").select("doc", "at").distinct()
    gain = F.least(F.lit(span), F.coalesce(F.lead("at").over(Window.partitionBy("doc").orderBy("at")) - F.col("at"), F.lit(span)))
    mine = mine.withColumn("gain", gain).groupBy("doc").agg(F.sum("gain").alias("shared")).withColumnRenamed("doc", "rep")
    size = same.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    all_ = docs.filter("doc is not null").select("doc", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    out = all_.join(same.join(size, "rep").join(mine, "rep", "left").select("doc", "n", "shared"), "doc", "left")
    return out.select("doc", "n_chars", F.when(F.col("n") > 1, F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0))).cast("long").alias("shared_chars"))
