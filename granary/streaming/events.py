"""Events as a stream: sightings per key, windows with late data, state with expiry, alerts.

Everything takes a streaming or a static table with ts, event_id, user_id, event_type, value; the same code runs on both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, *, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA.replace("ts timestamp", "ts timestamp_ntz")).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def sightings(events: DataFrame) -> DataFrame:
    """Per user and type: occurrences, first and last time, for update or complete mode."""
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def windows(events: DataFrame, *, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events and errors per window; rows later than ``late`` are too late, windows are closed by the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
    return w.agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")


def distinct_events(events: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Each event once, with state no longer than the watermark needs."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, *, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Debounced bursts: one row per run of a user's events with no gap longer than ``gap``."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return s.agg(F.count("*").alias("events"), F.max("ts").alias("last_ts")).select("user_id", "events", "last_ts")


def _lifecycle(hours: float | None):
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mounted, renders, most = state.get if state.exists else (False, 0, 0.0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "expired", renders, most)], columns=["user_id", "what", "renders", "most"])
            return
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind, value in zip(rows["event_type"], rows["value"], strict=True):
            if kind == "signup":
                mounted, renders, most = True, 0, 0.0
            elif kind == "error" and mounted:
                out.append((key[0], "left", renders, most))
                mounted = False
            elif pd.notna(value):
                renders, most = renders + 1, max(most, value)
        state.update((mounted, renders, most))
        if hours is not None:
            state.setTimeoutDuration(int(hours * 3_600_000))
        yield pd.DataFrame(out, columns=["user_id", "what", "renders", "most"])

    return fold


def lifecycle(events: DataFrame, *, expire_hours: float | None = None) -> DataFrame:
    """Mount and unmount per component (signup and error here): a row when a mounted one leaves.

    With ``expire_hours`` state that no event touches for so long ends with a row of its own; that needs a trigger by
    interval, since a run over what is there would wait for the last state to expire.
    """
    timeout = GroupStateTimeout.NoTimeout if expire_hours is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("user_id").applyInPandasWithState(_lifecycle(expire_hours), "user_id bigint, what string, renders bigint, most double", "mounted boolean, renders bigint, most double", "append", timeout)


def alerts(events: DataFrame, warning: float, critical: float) -> DataFrame:
    level = F.when(F.col("value") >= critical, "critical").when(F.col("value") >= warning, "warning")
    return events.select("event_id", "user_id", "value", level.alias("level")).filter("level is not null")


def start(out: DataFrame, target: str, checkpoint: str, *, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Runs a stream into parquet; ``every`` is an interval, without it what is there is worked off once."""
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.format("parquet").start(target)


def upsert(out: DataFrame, merge, checkpoint: str) -> StreamingQuery:
    """Hands every micro-batch to ``merge(batch, batch_id)``, for tables that are updated by key."""
    return out.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
