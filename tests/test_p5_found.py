"""p5_found: registration, and the cases that the docstring of implausible_readings states."""

import datetime

import __spark_entry__
import numpy as np
import pandas as pd
import pytest
from granary.operators.spikes import implausible_readings

SCHEMA = "metric_id bigint, source string, metric_name string, metric_value double, ts timestamp_ntz"
T0 = datetime.datetime(2023, 1, 1)


def series(values, first_id=1, source="a", name="render_time_ms", step_s=60):
    return [(first_id + k, source, name, None if v is None else float(v), T0 + datetime.timedelta(seconds=step_s * k)) for k, v in enumerate(values)]


def noise(n, seed=0, level=100.0):
    return (level + np.random.default_rng(seed).normal(0, 1, n)).tolist()


def found(spark, rows, **parameters):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.metric_id: r.reason for r in implausible_readings(df, **parameters).collect()}


def test_registered(spark):
    assert "p5_found" in __spark_entry__.queries()
    assert __spark_entry__.entry(spark).count() > 0
    df = __spark_entry__.queries()["p5_found"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["metric_id"]
    ids = [r.metric_id for r in df.collect()]
    assert ids and len(ids) == len(set(ids))


def test_limit_spike_stuck(spark):
    x = noise(300)
    x[50] = -1.0
    x[120:122] = [400.0, 390.0]
    x[200:215] = [101.0] * 15
    assert found(spark, series(x)) == {51: "limit", 121: "spike", 122: "spike", **dict.fromkeys(range(201, 216), "stuck")}


def test_lasting_change_is_no_case(spark):
    assert found(spark, series(noise(150) + noise(150, 1, 300.0))) == {}


def test_nulls_and_null_series(spark):
    x = noise(200)
    x[100] = 900.0
    x[99] = x[101] = None
    rows = series(x) + series(x, 1001, source=None) + [(None, "a", "render_time_ms", -5.0, T0), (5000, "a", "render_time_ms", -5.0, None)]
    assert found(spark, rows) == {101: "spike", 1101: "spike"}


def test_duplicates_and_equal_times(spark):
    x = noise(200)
    x[100] = 900.0
    rows = series(x)
    rows = [*rows, rows[100], *rows[:20]]
    assert found(spark, rows) == {101: "spike"}
    same = [(i, s, n, v, T0) for i, s, n, v, _ in series(x)]
    assert found(spark, same[::-1]) == {101: "spike"}


def test_empty_and_clashing_columns(spark):
    assert found(spark, []) == {}
    x = noise(200)
    x[100] = 900.0
    pdf = pd.DataFrame(series(x), columns=["metric_id", "source", "metric_name", "metric_value", "ts"])
    df = spark.createDataFrame(pdf)
    for c in ("_cell", "_block", "_at", "_n", "own", "block", "reason", "score", "_rank"):
        df = df.withColumn(c, df.metric_id * 0)
    assert [r.metric_id for r in implausible_readings(df).collect()] == [101]


@pytest.mark.parametrize("name", ["cpu_percent", "cache_hit_ratio"])
def test_upper_limit(spark, name):
    high = {"cpu_percent": 100.0, "cache_hit_ratio": 1.0}[name]
    x = [high * v / 200 for v in noise(200)]
    x[30] = high
    x[60] = high * 1.01
    assert found(spark, series(x, name=name)).get(61) == "limit"


@pytest.mark.parametrize("block_rows", [20_000, 400, 120])
def test_freeze_of_most_of_a_series(spark, block_rows):
    x = noise(900)
    x[100:750] = [101.0] * 650
    rows = series(x, step_s=60)
    assert found(spark, rows, block_rows=block_rows) == dict.fromkeys(range(101, 751), "stuck")


def test_long_runs_alone_are_normal(spark):
    rows = series(np.repeat(noise(20), 30)) + series([100.0] * 300, 1001, source="b")
    assert found(spark, rows) == {}
    assert found(spark, series(np.repeat(noise(20), 30) + 1000, name="bundle_size_kb")) == {}


def test_many_short_freezes(spark):
    x = noise(400)
    for k in range(10, 400, 20):
        x[k : k + 12] = [x[k]] * 12
    assert set(found(spark, series(x)).values()) == {"stuck"}
    assert len(found(spark, series(x))) == 20 * 12


def test_block_edges_within_one_hour(spark):
    x = noise(1500)
    x[1434:1454] = [101.0] * 20
    for k in (99, 199, 500, 602, 718, 799, 901):
        x[k : k + 3] = [300.0, 310.0, 290.0]
    whole = found(spark, series(x, step_s=1))
    assert len(whole) == 20 + 7 * 3
    assert found(spark, series(x, step_s=1), block_rows=100, halo_rows=60) == whole
    assert found(spark, [(i, s, n, v, T0) for i, s, n, v, _ in series(x)], block_rows=100, halo_rows=60) == whole
    # 720 readings in each clock hour
    assert found(spark, series(x, step_s=5), block_rows=100, halo_rows=60) == whole


def test_spike_at_the_start_and_short_series(spark):
    x = noise(200)
    x[:2] = [300.0, 310.0]
    x[-2:] = [300.0, 310.0]
    short = [100.0, 101.0, 900.0, 100.5, 99.5, -1.0, 100.0]
    rows = series(x) + series(short, 1001, source="b")
    assert found(spark, rows) == {1: "spike", 2: "spike", 1006: "limit"}
    assert found(spark, rows, block_rows=50, halo_rows=40) == {1: "spike", 2: "spike", 1006: "limit"}


def test_health_keeps_nameless_series(spark):
    from granary.operators.spikes import series_health

    m = spark.createDataFrame([(1, "s", None, 1.0), (1, "s", None, 1.0), (2, "s", None, None), (None, "s", "x", 1.0), (3, "s", "x", -1.0)], "metric_id bigint, source string, metric_name string, metric_value double")
    flags = spark.createDataFrame([(1, None, "limit"), (3, "x", "limit")], "metric_id bigint, metric_name string, reason string")
    got = {r.metric_name: (r.readings, r.present, r.sources, r.limit, r.spike) for r in series_health(flags, m).collect()}
    assert got == {None: (2, 1, 1, 1, 0), "x": (1, 1, 1, 1, 0)}


def test_block_size_changes_nothing(spark):
    m = spark.read.parquet("/root/testdata/sf0.01/metrics.parquet").filter("source in ('collector-main')")
    rows = [{(r.metric_id, r.reason) for r in implausible_readings(m, block_rows=b).select("metric_id", "reason").collect()} for b in (300, 20_000)]
    assert rows[0] == rows[1] and rows[0]
