"""Streams of file changes and events: debouncing, windows, sessions, incremental upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def last_per_path(changes: DataFrame) -> DataFrame:
    """Of a batch of (path, type, at) the last change of each path; the greater type on ties."""
    return changes.groupBy("path").agg(F.max(F.struct("at", "type")).alias("x")).select("path", "x.type", "x.at")


def debounced(changes: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "500 milliseconds") -> StreamingQuery:
    """Call ``handle`` with the last change of each path in every micro-batch; without ``every``, once for what is there.

    A batch that is repeated after a failure carries the same id.
    """
    w = changes.writeStream.foreachBatch(lambda d, i: handle(last_per_path(d), i)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def reanalysed(changes: DataFrame, reports: dict[str, Callable[[DataFrame], DataFrame]], sink: Callable[[str, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run batch reports anew for the paths that each micro-batch changed.

    A report gets the batch's paths with their last change (path, type, at) and joins what it
    needs; ``sink`` takes its name, its rows and the batch id. A report runs once a batch,
    however many paths changed.
    """

    def one(batch: DataFrame, i: int) -> None:
        last = last_per_path(batch).persist()
        try:
            for name, report in reports.items():
                sink(name, report(last), i)
        finally:
            last.unpersist()

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, at: str, keys: list[str], size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per key in tumbling or sliding windows; rows later than ``late`` are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, size, slide) if slide else F.window(at, size), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Counts per session of a key, closed by a gap."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))


def over_limit(events: DataFrame, at: str, client: str, most: int = 120, size: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Clients with more than ``most`` events in a window."""
    return windowed(events, at, [client], size, late=late).filter(F.col("n") > most)


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) so far, kept as state per key and given at each change; null values count as 0."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["v"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "total": [total]})

    d = events.select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"))
    return d.groupBy("k").applyInPandasWithState(update, "key string, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def upkeep(fingerprint_stream: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, Any], None], checkpoint: str) -> StreamingQuery:
    """Keep fingerprints up to date: each batch of (path, hash, at) replaces the rows of its paths; a null hash deletes."""

    def one(batch: DataFrame, i: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("hash", "at").alias("hash"))
        old = load()
        save(old.join(last.select("path"), "path", "left_anti").unionByName(last.filter("hash is not null")), i)

    return fingerprint_stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
