"""Cache policy over tables of entries (key, hits, size, created, last_access): scores, what to drop, where keys live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400.0


def priority(hits: Column, idle_seconds: Column, size: Column, age_seconds: Column) -> Column:
    """0 to 1: frequency 0.4, freshness within a day 0.3, smallness below a MiB 0.2 (unknown is small), youth within a week 0.1."""
    zero = F.lit(0.0)
    return F.least(hits / 10, F.lit(1.0)) * 0.4 + F.greatest(zero, 1 - idle_seconds / DAY) * 0.3 + F.when(size.isNull(), 1.0).otherwise(F.greatest(zero, 1 - size / 1048576.0)) * 0.2 + F.greatest(zero, 1 - age_seconds / (7 * DAY)) * 0.1


def expired(entries: DataFrame, now: Column, ttl_seconds: Column) -> DataFrame:
    """Entries older than their time to live; one exactly as old is still valid."""
    return entries.filter(now - F.col("last_access") > ttl_seconds)


def dynamic_ttl(interval: float, hits: Column) -> Column:
    """Grows with the logarithm of the hits, up to 24 intervals."""
    return F.least(F.lit(interval) * (1 + F.log10(hits + 1)), F.lit(interval * 24))


def over_capacity(entries: DataFrame, capacity: float, keep: float = 0.8, buckets: int = 4096) -> DataFrame:
    """The least recently used entries to drop until ``keep`` of the capacity is reached, nothing below capacity.

    The running sum is worked out in two steps, so that no task sorts all entries: sums per slice of time first, then
    within the one slice at which the limit is crossed.
    """
    total, lo, hi = entries.agg(F.sum(F.coalesce("size", F.lit(0))), F.min("last_access"), F.max("last_access")).first()
    if total is None or total < capacity:
        return entries.limit(0)
    e = entries.withColumn("_slice", F.least(F.floor((F.col("last_access") - lo) / max(hi - lo, 1e-9) * buckets), F.lit(buckets - 1)).cast("int"))
    sums = e.groupBy("_slice").agg(F.sum(F.coalesce("size", F.lit(0))).alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")  # at most `buckets` rows
    e = e.join(F.broadcast(before), "_slice")
    inside = Window.partitionBy("_slice").orderBy("last_access", "key").rowsBetween(Window.unboundedPreceding, -1)
    freed = F.col("_before") + F.coalesce(F.sum(F.coalesce("size", F.lit(0))).over(inside), F.lit(0))
    return e.withColumn("_freed", freed).filter(F.col("_freed") < total - keep * capacity).select(*entries.columns)


def keep_first(entries: DataFrame, limit: int) -> DataFrame:
    """The newest entries up to a limit (ties by key): a top-k, never a whole sort."""
    return entries.orderBy(F.desc("last_access"), "key").limit(limit)


def ring(nodes: list[tuple[str, int]], virtual: int = 100) -> list[tuple[int, str]]:
    """Places of the nodes' virtual copies on the ring, in order; on one place the later node stays."""
    places: dict[int, str] = {}
    for name, weight in nodes:
        for i in range(virtual * weight):
            h = 0
            for c in f"{name}:{i}":
                h = (h * 31 + ord(c)) & 0xFFFFFFFF
            places[abs(h - (1 << 32) if h >= 1 << 31 else h)] = name
    return sorted(places.items())


def routed(key_hash: Column, places: list[tuple[int, str]]) -> Column:
    """The node of the first place at or after a hash, round the ring; places are configuration, not data."""
    later = F.filter(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(n).alias("n")) for h, n in places]), lambda p: p["h"] >= key_hash)
    return F.coalesce(F.get(later, F.lit(0))["n"], F.lit(places[0][1]))
