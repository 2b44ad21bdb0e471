"""Reference graphs: paths from objects up to a root, roots, two-step cycles, kinds of chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.lineage import cut


def retention_paths(starts: DataFrame, edges: DataFrame, roots: DataFrame, *, max_steps: int = 64) -> DataFrame:
    """(object_id, path): every simple path from a start up over reversed edges to a root; path begins with the root.

    starts and roots have object_id, edges source_id and target_id.  A vertex that is no root and has no edge into it
    ends without a path; nulls are no vertices.  Each step joins the open paths, not the graph, with the edges; it is
    computed once and kept in the shared folder, and the walk ends when no path is open.  Paths that are still open
    after ``max_steps`` steps raise an error, they are never cut off silently.
    """
    step = edges.select(F.col("target_id").alias("_at"), F.col("source_id").alias("_up")).distinct()
    root = roots.select(F.col("object_id").alias("_up"), F.lit(True).alias("_root")).distinct()
    first = starts.select("object_id").filter("object_id is not null").distinct()
    walked = first.join(root, first["object_id"] == root["_up"], "left").select("object_id", F.col("object_id").alias("_at"), F.array("object_id").alias("path"), F.coalesce("_root", F.lit(False)).alias("_root"))
    found = []
    for _ in range(max_steps + 1):
        walked = cut(walked)
        found.append(walked.filter("_root").select("object_id", "path"))
        open_ = walked.filter("not _root").drop("_root")
        if open_.isEmpty():
            break
        walked = open_.join(step, "_at").filter(~F.array_contains("path", F.col("_up"))).join(root, "_up", "left")
        walked = walked.select("object_id", F.col("_up").alias("_at"), F.concat(F.array("_up"), "path").alias("path"), F.coalesce("_root", F.lit(False)).alias("_root"))
    else:
        raise ValueError(f"paths of more than {max_steps} steps: raise max_steps")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def tree_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are nobody's child."""
    return nodes.join(edges.select(F.col("target_id").alias("object_id")), "object_id", "left_anti")


def two_step_cycles(edges: DataFrame) -> DataFrame:
    """Objects that refer to themselves, or to one that refers back."""
    own = edges.filter("source_id = target_id").select(F.col("source_id").alias("object_id"))
    back = edges.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"))
    return own.union(edges.filter("source_id <> target_id").join(back, ["source_id", "target_id"], "left_semi").select(F.col("source_id").alias("object_id"))).distinct()


def chain_kind(kinds: Column) -> Column:
    """The kind of a chain by the kinds of its objects: what makes up a third of it, or occurs at all, in this order."""
    n = lambda k: F.size(F.filter(kinds, lambda x: x == k))
    third = F.size(kinds) / 3
    return (
        F.when((n("dom_node") > 0) & (n("dom_node") >= third), "dom_chain")
        .when(n("event_listener") > 0, "event_chain")
        .when((n("closure") > 0) & (n("closure") >= third), "closure_chain")
        .when(n("component_instance") > 0, "component_chain")
        .when(n("timer") > 0, "timer_chain")
        .otherwise("mixed_chain")
    )


def path_text(path: Column) -> Column:
    """root → next → … → object."""
    return F.array_join(path, " -> ")


def simplified(path: Column, kinds: Column, *, keep_kinds: tuple[str, ...] = ("dom_node", "component_instance", "closure", "event_listener", "timer"), gap: int = 10) -> Column:
    """A shorter path: first, last and key vertices, and the middle of a stretch of more than ``gap`` that is left out.

    Paths of at most three vertices are left as they are; a stretch that is left out is marked by ``...``.
    """
    n = F.size(path)
    wanted = lambda i: (i == 0) | (i == n - 1) | F.get(kinds, i).isin(*keep_kinds)
    kept = F.filter(F.sequence(F.lit(0), n - 1), wanted)
    far = lambda i, j: F.when(j - i > gap, F.array(F.floor((i + j) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    dense = F.flatten(F.transform(kept, lambda i, k: F.when(k == 0, F.array(i)).otherwise(F.concat(far(F.get(kept, k - 1), i), F.array(i)))))
    marked = F.flatten(F.transform(dense, lambda i, k: F.when((k > 0) & (i - F.get(dense, k - 1) > 1), F.array(F.lit("..."), F.get(path, i))).otherwise(F.array(F.get(path, i)))))
    return F.when(n <= 3, path).otherwise(marked)


def key_vertices(path: Column, kinds: Column, keep: tuple[str, ...]) -> Column:
    """Vertices of the given kinds; both ends if there are none and at least two vertices."""
    pairs = F.filter(F.arrays_zip(path.alias("p"), kinds.alias("k")), lambda z: z["k"].isin(*keep))
    found = F.transform(pairs, lambda z: z["p"])
    return F.when((F.size(found) == 0) & (F.size(path) >= 2), F.array(F.get(path, F.lit(0)), F.element_at(path, -1))).otherwise(found)
