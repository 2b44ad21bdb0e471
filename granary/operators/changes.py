"""What changed since the last run: files by time and size or by content, rules by version, objects between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import next_version


def changed_files(now: DataFrame, before: DataFrame, *, force: list[str] | None = None, include_new: bool = True) -> DataFrame:
    """(path, reason) of files to look at again: forced, new, newer or of another size. Both tables have path, mtime, size."""
    prev = before.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_known"))
    forced = F.lit(False)
    for part in force or []:
        forced = forced | F.col("path").contains(part)
    reason = F.when(forced, "forced").when(F.col("_known").isNull(), "new" if include_new else None).when(F.col("mtime") > F.col("_m"), "newer").when(F.col("_s").isNotNull() & ~F.col("size").eqNullSafe(F.col("_s")), "size")
    return now.join(prev, "path", "left").select("path", reason.alias("reason")).filter("reason is not null")


def restored(before: DataFrame, now: DataFrame, changed: DataFrame) -> DataFrame:
    """Earlier results of files that are still there and need no second look."""
    return before.join(now.select("path"), "path", "left_semi").join(changed.select("path"), "path", "left_anti")


def content_gate(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files whose (path, digest) no earlier run has."""
    return now.join(before.select("path", "digest"), ["path", "digest"], "left_anti")


def rule_digest(*columns: str) -> Column:
    """Digest over a rule's columns; a null is told from an empty text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def version_updates(rules: DataFrame, registry: DataFrame, *, major: bool = False) -> DataFrame:
    """(rule_id, update, previous, current): new, updated, unchanged and removed rules. Both have rule_id, digest; registry has version."""
    r = rules.select("rule_id", F.col("digest").alias("_d"), F.lit(True).alias("_here"))
    both = r.join(registry.select("rule_id", F.col("digest").alias("_old"), "version", F.lit(True).alias("_there")), "rule_id", "full_outer")
    update = F.when(F.col("_here").isNull(), "removed").when(F.col("_there").isNull(), "new").when(F.col("_d") == F.col("_old"), "unchanged").otherwise("updated")
    current = F.when(update == "new", "1.0.0").when(update == "unchanged", F.col("version")).when(update == "updated", next_version(F.col("version"), major))
    return both.select("rule_id", update.alias("update"), F.col("version").alias("previous"), current.alias("current"))


def snapshot_diff(base: DataFrame, target: DataFrame) -> DataFrame:
    """(object_id, change, size_before, size_after, retained, type, size_delta, change_rate) of objects that were added, removed or changed."""
    b = base.select("object_id", F.col("size").alias("size_before"), F.col("retained").alias("_r"), F.col("type").alias("_t"), F.lit(True).alias("_b"))
    t = target.select("object_id", F.col("size").alias("size_after"), "retained", "type", F.lit(True).alias("_a"))
    both = b.join(t, "object_id", "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when((F.col("size_before") != F.col("size_after")) | (F.col("_r") != F.col("retained")), "changed")
    delta = F.when(change == "changed", F.col("size_after") - F.col("size_before"))
    rate = F.abs(delta) / F.greatest(F.col("size_before"), F.lit(1))
    return both.select("object_id", change.alias("change"), "size_before", "size_after", F.coalesce("retained", "_r").alias("retained"), F.coalesce("type", "_t").alias("type"), delta.alias("size_delta"), rate.alias("change_rate")).filter("change is not null")


def leak_candidates(diff: DataFrame) -> DataFrame:
    """Objects of a diff that look like leaks: large or component objects that came and are held, and objects that grow fast."""
    came = (F.col("change") == "added") & (F.col("retained") > 0) & ((F.col("size_after") > 10_000) | (F.col("type") == "component_instance"))
    grew = (F.col("change") == "changed") & (F.col("size_delta") > 5_000) & (F.col("change_rate") > 0.5)
    return diff.filter(came | grew)


def leak_pattern(kind: Column, size: Column, name: Column, growing: Column) -> Column:
    """Struct of pattern and severity by an object's type, size, name and growth."""
    as_ = lambda p, s: F.struct(F.lit(p).alias("pattern"), (s if isinstance(s, Column) else F.lit(s)).alias("severity"))
    over = lambda n, a, b: F.when(size > n, a).otherwise(b)
    special = kind.isin("dom_node", "component_instance", "event_listener", "timer", "closure", "promise", "array", "set", "map")
    return (
        F.when(kind == "dom_node", as_("detached_dom", over(10_000, "high", "medium")))
        .when(kind == "component_instance", as_("zombie_component", over(50_000, "critical", "high")))
        .when(kind == "event_listener", as_("event_listener", "medium"))
        .when(kind == "timer", as_("timer_reference", "medium"))
        .when(kind == "closure", as_("closure_cycle", over(20_000, "high", "medium")))
        .when(kind == "promise", as_("promise_chain", "medium"))
        .when(kind.isin("array", "set", "map") & growing, as_("growing_collection", over(100_000, "high", "medium")))
        .when(kind.isin("array", "set", "map") & (size > 100_000), as_("large_cache", "medium"))
        .when(~special & (name.contains("Context") | name.contains("Provider")), as_("context_reference", "medium"))
        .when(~special & (name.contains("Store") | name.contains("Redux")), as_("redux_store", "medium"))
        .otherwise(as_("other", over(50_000, "high", "low")))
    )


#: Features of a leak by an object's kind and what is known of it: (feature, kind or None, key of the metadata, its value).
LEAK_FEATURES = (
    ("detached_dom", "dom_node", "detached", "true"),
    ("zombie_component", "component_instance", "unmounted", "true"),
    ("event_listener", "event_listener", "owner_unmounted", "true"),
    ("timer_reference", "timer", "owner_unmounted", "true"),
    ("closure_cycle", "closure", "cyclic", "true"),
    ("effect_dependencies", "closure", "missing_deps", "true"),
    ("context_reference", None, "context", "true"),
    ("redux_store", None, "store", "true"),
)


def leak_features(kind: Column, metadata: Column) -> Column:
    """Names of the features that an object shows; metadata is a map of texts, null is none."""
    known = F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    hits = []
    for name, needs, key, value in LEAK_FEATURES:
        ok = known[key].eqNullSafe(F.lit(value))
        hits.append(F.when(ok & (kind == needs) if needs else ok, F.lit(name)))
    return F.array_compact(F.array(*hits))


def confidence(features: Column, of: int = len(LEAK_FEATURES)) -> Column:
    """How many of all features an object shows, as a share."""
    return F.round(F.size(features) / of, 6)


def enriched(objects: DataFrame, notes: DataFrame, key: str = "pattern") -> DataFrame:
    """Objects with what a table of notes says of their pattern; objects without a note stay, with their own text."""
    n = notes.select(key, F.col("text").alias("_note"))
    return objects.join(n, key, "left").withColumn("text", F.coalesce("_note", "text")).drop("_note")
