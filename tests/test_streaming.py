"""Streams give what the same operators give on the whole table; late rows, repeated events and expiry."""

import datetime as dt

from pyspark.sql import functions as F

from granary.streaming import events as S

T0 = dt.datetime(2024, 1, 1)
ROWS = [(i, T0 + dt.timedelta(minutes=i * (1 if i % 7 else 3)), i % 3, ["signup", "view", "error", "click"][i % 4], float(i), None) for i in range(60)]
STATIC = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def source(spark, tmp_path, rows=ROWS):
    df = spark.createDataFrame(rows, STATIC)
    for k in range(3):
        df.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return S.read(spark, str(tmp_path / "in"), files_per_trigger=1), df.withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream, tmp_path, mode="append", name="out"):
    S.start(stream, str(tmp_path / name), str(tmp_path / f"{name}-cp"), mode=mode).awaitTermination()
    return stream.sparkSession.read.parquet(str(tmp_path / name))


def test_distinct_and_alerts(spark, tmp_path):
    stream, static = source(spark, tmp_path, ROWS + ROWS[:5])
    assert run(S.distinct_events(stream, late="30 days"), tmp_path, name="d").count() == 60
    got = {(r.event_id, r.level) for r in run(S.alerts(stream, 30, 50), tmp_path, name="a").collect()}
    assert got == {(i, "critical" if i >= 50 else "warning") for i in range(30, 60)}


def test_windows_close_and_match_the_static_table(spark, tmp_path):
    end = [(1000, T0 + dt.timedelta(days=30), 0, "view", 1.0, None)]
    stream, static = source(spark, tmp_path, ROWS + end)
    got = {(r.start, r.event_type, r.events) for r in run(S.windows(stream, late="2 days"), tmp_path).collect()}
    want = {(r.start, r.event_type, r.events) for r in S.windows(static).filter(F.col("start") < F.lit(T0 + dt.timedelta(days=20))).collect()}
    assert got == want and sum(x[2] for x in got) == 60


def test_sightings_by_upsert(spark, tmp_path):
    stream, static = source(spark, tmp_path)
    state = {}

    def merge(batch, _):
        state.update({(r.user_id, r.event_type): r.occurrences for r in batch.collect()})

    S.upsert(S.sightings(stream), merge, str(tmp_path / "cp")).awaitTermination()
    assert state == {(r.user_id, r.event_type): r.occurrences for r in S.sightings(static).collect()}


def test_lifecycle_state(spark, tmp_path):
    rows = [(1, T0, 7, "signup", 0.0, None), (4, T0 + dt.timedelta(minutes=1), 7, "view", 5.0, None), (7, T0 + dt.timedelta(minutes=2), 7, "view", 3.0, None), (10, T0 + dt.timedelta(minutes=3), 7, "error", None, None), (13, T0 + dt.timedelta(minutes=4), 7, "error", None, None)]
    stream, _ = source(spark, tmp_path, rows)
    assert [tuple(r) for r in run(S.lifecycle(stream), tmp_path).collect()] == [(7, "left", 2, 5.0)]


def test_sessions_on_the_static_table(spark):
    df = spark.createDataFrame(ROWS, STATIC).withColumn("ts", F.col("ts").cast("timestamp"))
    assert S.sessions(df, gap="1 second").count() == 60 and S.sessions(df.limit(0)).count() == 0
