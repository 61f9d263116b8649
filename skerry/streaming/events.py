"""Streams of events: bounces, bursts, compaction and index updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

BOUNCES = "key string, path string, ts timestamp, after double"


class BounceProcessor(StatefulProcessor):
    """Keeps a key's latest open; a modal soon after it is a bounce, and any modal clears it."""

    def __init__(self, seconds: float = 5.0, open_kind: str = "click", modal_kind: str = "view"):
        self.seconds, self.open_kind, self.modal_kind = seconds, open_kind, modal_kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("path", StringType()), StructField("us", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        whole = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"])
        now = self.last.get() if self.last.exists() else None
        for ts, kind, path in whole[["ts", "kind", "path"]].itertuples(index=False):
            us = ts.value // 1000
            if kind == self.open_kind:
                now = (path, us)
            elif kind == self.modal_kind and now is not None:
                if us - now[1] < self.seconds * 1e6:
                    out.append((str(key[0]), now[0], ts, (us - now[1]) / 1e6))
                now = None
        if now is not None:
            self.last.update((now[0], int(now[1])))
        elif self.last.exists():
            self.last.clear()
        yield pd.DataFrame(out, columns=["key", "path", "ts", "after"])

    def close(self) -> None:
        pass


def bounce_stream(events: DataFrame, key: str = "user", seconds: float = 5.0) -> DataFrame:
    """(event_id, ts, kind, path, key) to bounces, one state of a path and a time for each key."""
    rows = events.where(F.col("kind").isin("click", "view")).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy(key).transformWithStateInPandas(BounceProcessor(seconds), BOUNCES, "Append", "None")


def burst_stream(events: DataFrame, gap: str = "1 second", late: str = "10 minutes", key: str = "path") -> DataFrame:
    """A debounce for each key: a burst is given out once it has been quiet for the gap. late: the watermark, an
    addition of ours that bounds the state."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.max_by("op", F.struct("ts", "event_id")).alias("op")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "op")


def throttle_stream(events: DataFrame, every: str = "60 seconds", late: str = "10 minutes", key: str = "path") -> DataFrame:
    """Fixed windows with their pending keys."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", every).alias("w")).agg(F.collect_set(key).alias("keys")).select("w.start", "w.end", "keys")


def index_writer(store, describe: Callable[[DataFrame], DataFrame], paused: bool = False) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: compact a batch of file events, then put and delete in the store."""
    from skerry.operators.maintenance import allowed, compacted

    def write(batch: DataFrame, _: int) -> None:
        last = compacted(allowed(batch, paused)).persist()
        gone = last.where("op = 'delete'").select(F.col("path").alias("id"))
        if gone.limit(1).count():
            store.delete(gone, ("content",))
        live = last.where("op <> 'delete'").select("path")
        newest = batch.join(live, "path").groupBy("path").agg(F.max_by("content", F.struct("ts", "event_id")).alias("content"))
        if newest.limit(1).count():
            store.put("content", describe(newest))
        last.unpersist()

    return write


def recompute_writer(recompute: Callable[[], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch behind a throttled trigger: recompute once for each batch that isn't empty."""

    def write(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            recompute()

    return write
