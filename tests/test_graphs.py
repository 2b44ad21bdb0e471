"""Paths, cycles and chains on small graphs, against a plain search."""

import pytest
from pyspark.sql import functions as F

from granary.operators import graphs as G

EDGES = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "c"), ("x", "y"), ("y", "x"), ("e", "e"), (None, "d")]


def plain(at, path, edges, roots):
    if at in roots:
        return {tuple(path)}
    return {p for s, t in edges if t == at and s is not None and s not in path for p in plain(s, [s, *path], edges, roots)}


def test_all_simple_paths(spark):
    edges = spark.createDataFrame(EDGES + EDGES[:2], "source_id string, target_id string")
    vertices = ["r", "a", "b", "c", "d", "x", "y", "e", "alone"]
    starts = spark.createDataFrame([(v,) for v in [*vertices, None]], "object_id string")
    roots = spark.createDataFrame([("r",)], "object_id string")
    got = {(r.object_id, tuple(r.path)) for r in G.retention_paths(starts, edges, roots).collect()}
    assert got == {(v, p) for v in vertices for p in plain(v, [v], EDGES, {"r"})}
    with pytest.raises(ValueError):
        G.retention_paths(starts, edges, roots, max_steps=1)
    assert G.retention_paths(starts.limit(0), edges, roots).count() == 0
    assert {r[0] for r in G.two_step_cycles(edges).collect()} == {"c", "d", "x", "y", "e"}
    assert {r[0] for r in G.tree_roots(starts.filter("object_id is not null"), edges).collect()} == {"r", "alone"}


def test_chains_and_short_paths(spark):
    row = spark.range(1).select(
        G.chain_kind(F.array(F.lit("dom_node"), F.lit("x"), F.lit("y"))).alias("dom"),
        G.chain_kind(F.array(F.lit("dom_node"), F.lit("x"), F.lit("y"), F.lit("timer"))).alias("timer"),
        G.chain_kind(F.array().cast("array<string>")).alias("none"),
        G.simplified(F.sequence(F.lit(0), F.lit(30)).cast("array<string>"), F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.when(i == 3, "timer").otherwise("x"))).alias("long"),
        G.simplified(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x"), F.lit("x"))).alias("short"),
    ).first()
    assert (row.dom, row.timer, row.none) == ("dom_chain", "timer_chain", "mixed_chain")
    assert row.long == ["0", "...", "3", "...", "16", "...", "30"] and row.short == ["a", "b"]
