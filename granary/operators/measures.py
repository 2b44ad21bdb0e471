"""Metrics and events over time: counters, windows of the last readings, running figures, alerts, debouncing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_readings(metrics: DataFrame) -> DataFrame:
    """Readings delivered twice count once (the earliest delivery)."""
    first = metrics.groupBy("metric_id").agg(F.min(F.struct("ingest_ts", "source", "metric_name", "metric_type", "metric_value", "ts")).alias("r"))
    return first.select("metric_id", "r.*")


def latest(metrics: DataFrame) -> DataFrame:
    """Gauges: the last reading of each series; nulls don't count, of equal times the higher id."""
    return metrics.filter("metric_value is not null").groupBy("source", "metric_name").agg(F.max_by("metric_value", F.struct("ts", "metric_id")).alias("metric_value"), F.count("*").alias("readings"))


def histogram(metrics: DataFrame, width: float) -> DataFrame:
    """Readings per metric and bucket of a width."""
    bucket = F.floor(F.col("metric_value") / width).cast("bigint")
    return metrics.filter("metric_value is not null").groupBy("metric_name", bucket.alias("bucket")).agg(F.count("*").alias("readings"))


def increases(metrics: DataFrame) -> DataFrame:
    """Counters: how much each series rose in all; a fall is a restart, from which the new value counts."""
    by = Window.partitionBy("source", "metric_name").orderBy("ts", "metric_id")
    m = metrics.filter("metric_value is not null").withColumn("_p", F.lag("metric_value").over(by))
    rise = F.when(F.col("_p").isNull(), 0.0).when(F.col("metric_value") < F.col("_p"), F.col("metric_value")).otherwise(F.col("metric_value") - F.col("_p"))
    return m.withColumn("rise", rise).groupBy("source", "metric_name").agg(F.sum("rise").alias("rise"), F.count_if(F.col("metric_value") < F.col("_p")).alias("restarts"))


def last_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key; a rank with a limit, which Spark cuts per partition before the shuffle."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def rolling(rows: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Mean, greatest and number of the last n values up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return rows.select("*", F.avg(value).over(w).alias("mean"), F.max(value).over(w).alias("most"), F.count(value).over(w).alias("n"))


def running(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Sum, mean and greatest of all values up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", F.sum(value).over(w).alias("total"), F.avg(value).over(w).alias("mean"), F.max(value).over(w).alias("most"))


def changes_to_previous(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Difference and share against the value before; none for the first."""
    p = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.select("*", (F.col(value) - p).alias("change"), F.when(p != 0, (F.col(value) - p) / p * 100).alias("change_pct"))


def alerts(rows: DataFrame, value: str, warning: float, critical: float) -> DataFrame:
    """Rows that reach a threshold (equal counts), critical before warning."""
    level = F.when(F.col(value) >= critical, "critical").when(F.col(value) >= warning, "warning")
    return rows.withColumn("level", level).filter("level is not null")


def render_stats(events: DataFrame, threshold: float) -> DataFrame:
    """Per component: renders, mean, greatest and last time, and needless renders (below the threshold, never the first).

    events has component, ts, event_id, phase, took; rows without a time or with none taken are skipped.
    """
    e = events.filter("took is not null and took <> 0")
    nth = F.row_number().over(Window.partitionBy("component").orderBy("ts", "event_id"))
    e = e.withColumn("_n", nth)
    needless = F.count_if((F.col("_n") > 1) & (F.col("phase") == "update") & (F.col("took") < threshold))
    return e.groupBy("component").agg(F.count("*").alias("renders"), F.avg("took").alias("mean"), F.max("took").alias("most"), F.max_by("took", F.struct("ts", "event_id")).alias("last"), needless.alias("needless"))


def bursts(events: DataFrame, keys: list[str], gap_seconds: float) -> DataFrame:
    """Debouncing: the last event of every run whose events follow each other within the gap, with the run's length."""
    by = Window.partitionBy(*keys).orderBy("ts", "event_id")
    after = F.lead("ts").over(by)
    ends = after.isNull() | (F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > int(gap_seconds * 1e6))
    starts = F.lag("ts").over(by)
    fresh = starts.isNull() | (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(starts.cast("timestamp")) > int(gap_seconds * 1e6))
    marked = events.withColumn("_run", F.sum(fresh.cast("int")).over(by)).withColumn("_end", ends)
    sized = marked.withColumn("length", F.count("*").over(Window.partitionBy(*keys, "_run")))
    return sized.filter("_end").drop("_run", "_end")


def fresh(state: DataFrame, last: str, as_of: Column, hours: int) -> DataFrame:
    """State that has not expired: a row exactly as old as the limit stays."""
    return state.filter(F.col(last) >= as_of - F.make_interval(hours=F.lit(hours)))


def feedback_accuracy(rows: DataFrame, keys: list[str], right: Column) -> DataFrame:
    """Judgements per key: all, right ones, accuracy and rate of false alarms."""
    return rows.groupBy(*keys).agg(F.count("*").alias("judged"), F.count_if(right).alias("right")).withColumn("accuracy", F.round(F.col("right") / F.col("judged"), 6)).withColumn("false_rate", F.round(1 - F.col("right") / F.col("judged"), 6))
