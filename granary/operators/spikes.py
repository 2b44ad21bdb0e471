"""Implausible readings in measurement series (state-space forecasting).

A series is ``(source, metric_name)`` in the order of ``ts``.  Every series is filtered with a local-level
Kalman filter with drift: a reading whose standardised innovation is above the threshold is withheld from the update;
when the series returns within ``max_spike`` readings the withheld ones are spikes, otherwise the level has
moved for good and the filter restarts there.  Readings over which the innovation variance vanishes (in a
series that normally changes) are stuck, readings outside the limits of their metric are impossible.

A series normally changes if, counted over all its blocks outside the runs of ``min_run`` or more, at most
``max_equal_share`` of its steps are equal, and it changes there at least ``min_run`` times and more often than it has
such runs: a series that is nothing but long runs gives no sign that it should change.

Scale: a series is cut by rank into blocks of ``block_rows`` readings (the last one below twice that) with overlap on
both sides, so that no Python task holds a whole unbounded series, however its readings lie in time; counts per
(series, hour) are the only thing aggregated beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Closed limits (low, high) of a metric's readings; a name that is not listed has low 0.
METRIC_LIMITS: dict[str, tuple[float, float]] = {
    "heap_used_mb": (0.0, float("inf")),
    "cpu_percent": (0.0, 100.0),
    "render_time_ms": (0.0, float("inf")),
    "cache_hit_ratio": (0.0, 1.0),
    "queue_length": (0.0, float("inf")),
    "issues_total": (0.0, float("inf")),
    "bundle_size_kb": (0.0, float("inf")),
}

#: Metrics whose values seldom change by nature; their constant stretches are never stuck.
SELDOM_CHANGING: frozenset[str] = frozenset({"bundle_size_kb"})

BLOCK_SCHEMA = "metric_id bigint, source string, metric_name string, metric_value double, bad boolean, stuck boolean, score double, equal bigint, steps bigint, changes bigint, runs bigint"


def _spread(x: np.ndarray) -> float:
    """Robust standard deviation: scaled median absolute deviation, or the mean one where more than half are equal."""
    if len(x) == 0:
        return 0.0
    d = np.abs(x - np.median(x))
    m = float(np.median(d)) * 1.4826
    if m == 0.0:
        m = float(np.sort(d)[: max(1, int(len(d) * 0.95))].mean()) * 1.2533
    return m


def noise_model(x: np.ndarray) -> tuple[float, float]:
    """(q, r): variances of the level's step and of the reading's noise, from differences at lags 1 and 2."""
    if len(x) < 4:
        return 0.0, 0.0
    d1, d2 = x[1:] - x[:-1], x[2:] - x[:-2]
    m1, m2 = _spread(d1) ** 2, _spread(d2) ** 2
    if m1 == 0.0:
        return 0.0, 0.0
    q = min(max(m2 - m1, 0.02 * m1), 0.9 * m1)  # with q at 0 the filter would no longer follow, and an error of the drift would add up
    return q, max((m1 - q) / 2, 0.02 * m1)


def _level_at(values: list[float], drift: float) -> float:
    """The level at the first of a few readings: the median of what they say of it."""
    return float(np.median([v - k * drift for k, v in enumerate(values)]))


def _one_way(values: list[float], q: float, r: float, drift: float, threshold: float, max_spike: int) -> np.ndarray:
    """Standardised innovation of every withheld reading after which the series came back, 0 elsewhere."""
    n = len(values)
    score = np.zeros(n)
    # here and after a restart up to max_spike of the readings may be off
    level, var = _level_at(values[: 2 * max_spike + 1], drift) - drift, r
    held: list[int] = []
    scores: list[float] = []
    bound = threshold * threshold
    i = 0
    while i < n:
        level += drift
        innovation = values[i] - level
        prior = var + q
        s = prior + r
        if innovation * innovation < bound * s:
            if held:
                score[held] = scores
                held, scores = [], []
            gain = prior / s
            level += gain * innovation
            var = gain * r
        else:
            held.append(i)
            scores.append(abs(innovation) / s**0.5)
            var = prior
            if len(held) > max_spike:  # it does not return: a lasting change of level; go on from the new one
                i = held[0]
                level, var = _level_at(values[i : i + 2 * max_spike + 1], drift), r
                held, scores = [], []
                # the reading that began the change is taken as it is if it is off the new level too; either way the filter goes on behind it
                if abs(values[i] - level) < threshold * (var + q + r) ** 0.5:
                    gain = (var + q) / (var + q + r)
                    level += gain * (values[i] - level)
                    var = (1 - gain) * (var + q)
        i += 1
    return score


def kalman_spikes(x: np.ndarray, threshold: float, max_spike: int, moving: np.ndarray | None = None, begins: bool = False) -> np.ndarray:
    """Score of every spike reading, 0 elsewhere; ``x`` holds finite readings in order.

    ``moving`` is False for readings that tell nothing of noise and drift, such as the repeats of a long run.

    The filter runs forwards and backwards and a spike is one for both, so the start of a trend or of a new level,
    which only one direction finds surprising, is none.  Where the series itself ``begins``, the pass backwards can't
    see a return, and the pass forwards alone decides on the first readings; the last readings of a series, which are
    not seen to return, are none.  Under 8 readings there is no usual scatter to go by, and no spike.
    """
    if len(x) < 8:
        return np.zeros(len(x))
    usual = x if moving is None or moving.sum() < 8 else x[moving]
    q, r = noise_model(usual)
    if q + r <= 0.0:  # a series that hardly ever moves has no scatter: any short excursion stands out
        r = max(1e-9, (1e-6 * float(np.median(np.abs(x)))) ** 2)
    values = x.tolist()
    drift = float(np.median(np.diff(usual)))
    ahead = _one_way(values, q, r, drift, threshold, max_spike)
    if not ahead.any():
        return ahead
    both = np.minimum(ahead, _one_way(values[::-1], q, r, -drift, threshold, max_spike)[::-1])
    if begins:
        first = int(np.argmin(ahead > 0))  # of the leading spike, if there is one
        both[:first] = ahead[:first]
    return both


def vanishing_variance(x: np.ndarray, min_run: int) -> tuple[np.ndarray, np.ndarray]:
    """(reading is where the innovation variance vanishes, reading brings an innovation).

    While a series stands still the filter's own level still drifts towards it, so its innovations only fade.  Those of
    the state-space model whose level takes up each reading whole (no reading noise, gain 1) stop at once: they are the
    steps from reading to reading.  Their variance over ``min_run`` readings is kept as a moving sum of squares; where it
    is zero, all readings of that window are stuck.  The test is exact: a window of equal readings, and no other.
    """
    if len(x) == 0:
        return np.zeros(0, bool), np.zeros(0, bool)
    innovation = np.concatenate([[np.inf], np.diff(x)])
    moves = innovation != 0
    # squares of steps may underflow; whether a step is zero may not
    total = np.concatenate([[0], np.cumsum(moves)])
    n = len(x)
    stuck = np.zeros(n + 1, np.int64)
    if n >= min_run:
        first = np.arange(n - min_run + 1)
        still = first[total[first + min_run] - total[first + 1] == 0]  # no innovation behind the window's first reading
        np.add.at(stuck, still, 1)
        np.add.at(stuck, still + min_run, -1)
    return np.cumsum(stuck)[:n] > 0, moves


def score_block(x: np.ndarray, own: np.ndarray, begins: bool, name: str | None, limits: dict[str, tuple[float, float]], threshold: float, max_spike: int, min_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int, int, int]]:
    """(bad, stuck, score) of one block of one series in order, and its own steps' counts.

    ``equal`` and ``steps`` are outside the long runs, ``changes`` are short runs, ``runs`` long ones that begin here.
    """
    low, high = limits.get(name, (0.0, float("inf")))
    bad = ~np.isfinite(x) | (x < low) | (x > high)
    # the filter runs over all finite readings: a reading outside the limits is one of the withheld ones
    ok = np.flatnonzero(np.isfinite(x))
    y = x[ok]
    long, starts = vanishing_variance(y, min_run)
    stuck, score = np.zeros(len(x), bool), np.zeros(len(x))
    stuck[ok] = long & (name not in SELDOM_CHANGING)
    score[ok] = kalman_spikes(y, threshold, max_spike, starts | ~stuck[ok], begins)
    mine = own[ok]
    short = mine & ~long
    return bad, stuck, score, (int((short & ~starts).sum()), int(short.sum()), int((short & starts).sum()), int((mine & long & starts).sum()))


def score_blocks(batches: Iterator[pd.DataFrame], limits: dict[str, tuple[float, float]], threshold: float, max_spike: int, min_run: int) -> Iterator[pd.DataFrame]:
    """Candidates of all blocks of a partition that is sorted by source, metric_name, block, ts and metric_id.

    A block may go on in the next batch; nothing else is held.  Of every block one row more, without metric_id, counts
    its own steps.
    """
    keys = ["source", "metric_name", "block"]

    def score(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        ids, x, own, begins = pdf["metric_id"].to_numpy(np.int64), pdf["metric_value"].to_numpy(float), pdf["own"].to_numpy(bool), pdf["begins"].to_numpy(bool)
        sources, names = pdf["source"].to_numpy(object), pdf["metric_name"].to_numpy(object)
        rows: list[tuple] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            source, name = sources[a], names[a]
            bad, stuck, scores, counts = score_block(x[a:b], own[a:b], bool(begins[a:b].any()), name, limits, threshold, max_spike, min_run)
            for k in np.flatnonzero((bad | stuck | (scores > 0)) & own[a:b]).tolist():
                rows.append((int(ids[a + k]), source, name, x[a + k], bool(bad[k]), bool(stuck[k]), float(scores[k]), 0, 0, 0, 0))
            rows.append((None, source, name, None, False, False, 0.0, *counts))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")]).astype({"metric_id": "Int64"})

    rest: pd.DataFrame | None = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), bool)
        for key in keys:
            v = pd.factorize(pdf[key])[0]  # nulls are a value of their own
            change[1:] |= v[1:] != v[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change)])
        if len(cuts) > 1:
            yield score(pdf, cuts)
        rest = pdf.iloc[cuts[-1] :]
    if rest is not None and len(rest):
        yield score(rest.reset_index(drop=True), np.array([0, len(rest)]))


def implausible_readings(
    metrics: DataFrame,
    *,
    limits: dict[str, tuple[float, float]] | None = None,
    threshold: float = 8.5,
    max_spike: int = 3,
    min_run: int = 12,
    max_equal_share: float = 0.5,
    block_rows: int = 20_000,
    halo_rows: int = 200,
) -> DataFrame:
    """Readings that jump, freeze or take impossible values: metric_id, source, metric_name, metric_value, reason, score.

    Nulls: a reading with a null value, ts or metric_id is never flagged and takes no part in the filter; null
    source or metric_name are series of their own.  Duplicate rows (same series and metric_id) count once, as the
    earliest; readings of equal
    ts are ordered by metric_id.  An empty table gives an empty result; extra columns are ignored.
    """
    limits = METRIC_LIMITS if limits is None else limits
    if halo_rows < min_run:
        raise ValueError("halo_rows is less than min_run: runs at block edges would not be seen whole")
    key = ["source", "metric_name"]
    m = metrics.select("metric_id", *key, F.col("ts").cast("timestamp").alias("ts"), F.col("metric_value").cast("double").alias("metric_value")).filter("metric_id is not null and ts is not null and metric_value is not null")
    # structs of nulls are equal, so a series is one key, null or not
    m = m.groupBy(F.struct(*key).alias("_series"), "metric_id").agg(F.min(F.struct("ts", "metric_value")).alias("_r")).select("_series", "metric_id", "_r.*")
    m = m.withColumn("_cell", F.date_trunc("hour", "ts"))
    cells = m.groupBy("_series", "_cell").agg(F.count("*").alias("_n"))
    ordered = Window.partitionBy("_series").orderBy("_cell")
    cells = cells.withColumn("_start", F.sum("_n").over(ordered) - F.col("_n")).withColumn("_total", F.sum("_n").over(Window.partitionBy("_series")))
    # the rank of a reading in its series is its rank in the cell after the readings of earlier cells
    ranked = m.withColumn("_rank", F.row_number().over(Window.partitionBy("_series", "_cell").orderBy("ts", "metric_id")))
    ranked = ranked.join(cells, ["_series", "_cell"]).withColumn("rank", F.col("_start") + F.col("_rank") - 1)
    # blocks of block_rows, the last one up to twice that; a reading is also read by the blocks that it is within halo_rows of
    last = F.expr(f"greatest(0, _total div {block_rows} - 1)")
    block = lambda shift: F.greatest(F.lit(0), F.least(last, F.floor((F.col("rank") + shift) / block_rows)))
    uses = F.sequence(block(-halo_rows), block(halo_rows))
    rows = ranked.withColumn("_own", block(0)).select("_series.*", "metric_id", "ts", "metric_value", "_own", (F.col("rank") == 0).alias("begins"), F.explode(uses).alias("block"))
    rows = rows.select(*key, "metric_id", "ts", "metric_value", "begins", "block", (F.col("block") == F.col("_own")).alias("own"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return score_blocks(batches, limits, threshold, max_spike, min_run)

    rows = rows.select("metric_id", *key, "block", "ts", "metric_value", "own", "begins").repartition(*key, "block").sortWithinPartitions(*key, "block", "ts", "metric_id")
    found = rows.drop("ts").mapInPandas(run, BLOCK_SCHEMA)
    # what is normal for the series: its steps outside the long runs, over all its blocks
    series = Window.partitionBy(*key)
    found = found.select("*", *[F.sum(c).over(series).alias(f"_{c}") for c in ("equal", "steps", "changes", "runs")])
    changing = (F.col("_equal") <= max_equal_share * (F.col("_steps") + F.col("_runs"))) & (F.col("_changes") >= min_run) & (F.col("_changes") > F.col("_runs"))
    reason = F.when(F.col("bad"), "limit").when(F.col("stuck") & changing, "stuck").when(F.col("score") > 0, "spike")
    score = F.when(reason == "limit", float("inf")).when(reason == "stuck", 0.0).otherwise(F.col("score"))
    return found.filter("metric_id is not null").select("metric_id", "source", "metric_name", "metric_value", reason.alias("reason"), score.alias("score")).filter("reason is not null")


def series_health(flags: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per metric_name: readings, those with a value, distinct series, and the flagged ones by reason.

    A null metric_name is a name of its own; rows without metric_id are no readings; repeated rows count once.
    """
    once = metrics.filter("metric_id is not null").groupBy("metric_id").agg(F.min(F.struct("metric_name", "source", "metric_value")).alias("r")).select("r.*")
    totals = once.groupBy("metric_name").agg(F.count("*").alias("readings"), F.count("metric_value").alias("present"), F.countDistinct("source").alias("sources"))
    reasons = ("limit", "spike", "stuck")
    found = flags.groupBy(F.col("metric_name").alias("_name")).agg(*[F.count_if(F.col("reason") == r).alias(r) for r in reasons])
    joined = totals.join(found, F.col("metric_name").eqNullSafe(F.col("_name")), "left").drop("_name")
    return joined.fillna(0, list(reasons))
