"""Attribute histories as a bitemporal ledger.

Each change says: from its valid time on the attribute has a value; it was recorded
later. A change that arrives late splits the interval that was believed until then. The
old row is closed in recorded time, never overwritten, and its two halves are added.

In order of valid time, a change's predecessor *as of its arrival* is the nearest earlier
change that was recorded before it, its successor the nearest later one recorded before
it. A sweep over the valid order finds the cuts between which arrivals are out of order;
only those short stretches need a stack, everything else follows from the neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.scalars import micros
from repolith.operators.ordered import by_time, fits, neighbours
from repolith.session import cut


def change_log(raw: DataFrame) -> DataFrame:
    """Issue changes as (entity, attr, born, v, seq, old, new, r).

    ``attr`` is the field trimmed in lower case; rows with one history id and field are
    one, the first recorded. Rows without entity, field, id or time are ignored. A null
    recorded time counts as the valid time.
    """
    d = raw.select(
        F.col("issue_key").alias("entity"), F.lower(F.trim("field")).alias("attr"), micros("issue_created_at").alias("born"),
        micros("created_at").alias("v"), F.col("history_id").alias("seq"), F.col("from_string").alias("old"), F.col("to_string").alias("new"),
        F.coalesce(micros("ingested_at"), micros("created_at")).alias("r"),
    ).dropna(subset=["entity", "attr", "v", "seq"])
    row = F.struct("r", "v", "entity", "born", "old", "new")
    return d.groupBy("seq", "attr").agg(F.min(row).alias("x")).select("seq", "attr", "x.*")


def _nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by stretch and valid order: add the predecessor and successor as of arrival."""
    held: pd.DataFrame | None = None

    def solve(d: pd.DataFrame) -> pd.DataFrame:
        key = list(zip(d["entity"], d["attr"], d["cut_v"], d["cut_seq"]))
        r, seq, n = d["r"].to_numpy(), d["seq"].to_numpy(), len(d)
        before, after = [-1] * n, [-1] * n
        stack: list[int] = []
        for i in range(n):
            if i and key[i] != key[i - 1]:
                stack = []
            while stack and (r[stack[-1]], seq[stack[-1]]) > (r[i], seq[i]):
                after[stack.pop()] = i
            if stack:
                before[i] = stack[-1]
            elif i and key[i] == key[i - 1]:
                before[i] = -2  # none in the stretch: what precedes its first row
            stack.append(i)
        first, at = list(range(n)), 0
        for i in range(n):
            at = i if not i or key[i] != key[i - 1] else at
            first[i] = at
        out = d.copy()
        for c, p in (("v", "pv"), ("seq", "pseq"), ("new", "pnew")):
            have, outer = d[c].tolist(), d[f"prev_{c}"].tolist()
            out[p] = [have[b] if b >= 0 else outer[first[i]] for i, b in enumerate(before)]
        v = d["v"].tolist()
        out["nv"] = [v[a] if a >= 0 else None for a in after]
        return out[["entity", "attr", "born", "v", "seq", "old", "new", "r", "pv", "pseq", "pnew", "nv"]]

    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(b):
            continue
        last = b.iloc[-1]
        open_ = (b["entity"] == last["entity"]) & (b["attr"] == last["attr"]) & (b["cut_v"] == last["cut_v"]) & (b["cut_seq"] == last["cut_seq"])
        held, done = b[open_].reset_index(drop=True), b[~open_].reset_index(drop=True)
        if len(done):
            yield solve(done)
    if held is not None and len(held):
        yield solve(held)


def ledger(log: DataFrame, bucket_us: int | None = None) -> DataFrame:
    """The whole ledger of a ``change_log``.

    Gives entity, attr, owner (id of the change, null for the state before the first one),
    value, valid_from, valid_to, recorded_from, recorded_to, all in microseconds; null
    valid_to/recorded_to are open. Rows that are valid for no time are left out.
    """
    keys, bucket = ["entity", "attr"], by_time("v", bucket_us)
    log = cut(log)
    whole = fits(log, keys)
    d = log.withColumn("rec", F.struct("r", "seq"))
    d = neighbours(d, keys, ["v", "seq"], bucket, prev=["v", "seq", "new"], before_max=["rec"], after_min=["rec"], whole=whole)
    # a cut lies before a row if everything earlier in valid order was also recorded earlier
    low = F.when(F.col("min_after_rec").isNull() | (F.col("rec") < F.col("min_after_rec")), F.col("rec")).otherwise(F.col("min_after_rec"))
    d = d.withColumn("cut", F.when(F.col("max_before_rec").isNull() | (F.col("max_before_rec") < low), F.struct("v", "seq")))
    d = neighbours(d, keys, ["v", "seq"], bucket, nxt=["cut"], up_to_max=["cut"], whole=whole)
    d = d.withColumns({"alone": F.col("cut").isNotNull() & (F.col("next_cut").isNotNull() | F.col("min_after_rec").isNull()), "cut_v": F.col("max_upto_cut.v"), "cut_seq": F.col("max_upto_cut.seq")})
    d = cut(d)
    cols = ["entity", "attr", "born", "v", "seq", "old", "new", "r"]
    near = d.filter("alone").select(*cols, F.col("prev_v").alias("pv"), F.col("prev_seq").alias("pseq"), F.col("prev_new").alias("pnew"), F.lit(None).cast("long").alias("nv"))
    late = d.filter("not alone").select(*cols, "prev_v", "prev_seq", "prev_new", "cut_v", "cut_seq")
    late = late.repartition("entity", "attr", "cut_v", "cut_seq").sortWithinPartitions("entity", "attr", "cut_v", "cut_seq", "v", "seq")
    kinds = "entity string, attr string, born long, v long, seq long, old string, new string, r long, pv long, pseq long, pnew string, nv long"
    near = near.unionByName(late.mapInPandas(_nearest, kinds))
    rows = F.explode(
        F.array(
            F.struct(F.col("seq").alias("owner"), F.col("new").alias("value"), F.col("v").alias("valid_from"), F.col("nv").alias("valid_to"), F.lit(0).alias("again")),
            F.struct(F.col("pseq").alias("owner"), F.when(F.col("pv").isNull(), F.col("old")).otherwise(F.col("pnew")).alias("value"), F.coalesce("pv", "born").alias("valid_from"), F.col("v").alias("valid_to"), F.lit(1).alias("again")),
        )
    )
    out = near.select("entity", "attr", F.col("r").alias("recorded_from"), "seq", rows.alias("x")).select("entity", "attr", "x.*", "recorded_from", "seq")
    # versions of one owner follow each other in recorded time; an owner's versions are as many as changes right after it
    w = Window.partitionBy("entity", "attr", "owner").orderBy("recorded_from", "seq")
    out = out.withColumn("recorded_to", F.lead("recorded_from").over(w))
    return out.filter("valid_from is not null and (valid_to is null or valid_from < valid_to) and (recorded_to is null or recorded_from < recorded_to)").drop("again", "seq")


def as_of(book: DataFrame, recorded: int | None = None) -> DataFrame:
    """What was believed at a recorded time (now, if none is given)."""
    return book.filter("recorded_to is null" if recorded is None else f"recorded_from <= {int(recorded)} and (recorded_to is null or recorded_to > {int(recorded)})")


def versions(book: DataFrame, recorded: int | None = None, bucket_us: int | None = None) -> DataFrame:
    """Believed versions with successive equal values (trimmed, ignoring case, null as empty) made one."""
    keys, bucket = ["entity", "attr"], by_time("valid_from", bucket_us)
    d = as_of(book, recorded).withColumn("norm", F.lower(F.trim(F.coalesce("value", F.lit("")))))
    d = cut(d.select(*keys, "value", "norm", "valid_from"))
    whole = fits(d, keys)
    d = neighbours(d, keys, ["valid_from"], bucket, prev=["norm"], whole=whole)
    d = d.filter("prev_norm is null or prev_norm <> norm").drop("prev_norm")
    d = neighbours(d, keys, ["valid_from"], bucket, nxt=["valid_from"], whole=whole)
    return d.select(*keys, "value", "valid_from", F.coalesce("next_valid_from", F.lit(-1)).cast("long").alias("valid_to"))
