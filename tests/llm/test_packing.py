"""Packing against a plain best-fit, its promises on whole tables, and edge cases."""

import random

import pytest

from granary.llm.packing import best_fit, fill_rates, packed


def plain(sizes, capacity, separator):
    """Best-fit decreasing by a look at every open container; sizes that need no cut."""
    rooms = []
    for less, _ in sorted((-s, i) for i, s in sizes if s):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= separator - less]
        if fits:
            k = min(fits)[1]
        else:
            rooms.append(capacity + separator)
            k = len(rooms) - 1
        rooms[k] -= separator - less
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_tightest_fit(seed):
    rng = random.Random(seed)
    capacity, separator = rng.choice([1, 7, 64, 100]), rng.choice([0, 1, 3])
    sizes = [(i, rng.randrange(capacity + 1)) for i in range(rng.randrange(80))]
    used = {}
    for container, _, _, _, tokens in best_fit(sizes, capacity, separator):
        used.setdefault(container, []).append(tokens)
    rooms = sorted(capacity + separator - sum(t + separator for t in x) for x in used.values())
    assert rooms == plain(sizes, capacity, separator) and all(r >= 0 for r in rooms)


def test_only_what_is_too_large_is_cut():
    out = best_fit([(1, 25), (2, 10), (3, 20), (4, 0)], 10, 1)
    parts = {}
    for container, i, part, start, tokens in out:
        parts.setdefault(i, []).append((part, start, tokens))
    assert {i: sorted(p) for i, p in parts.items()} == {1: [(0, 0, 10), (1, 10, 10), (2, 20, 5)], 2: [(0, 0, 10)], 3: [(0, 0, 10), (1, 10, 10)]}


def test_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "word " * 50), (3, ""), (4, None), (None, "x"), (5, "<|endoftext|>")], "doc_id bigint, text string").selectExpr("*", "1 as shard", "2 as tokens")
    boxes = spark.createDataFrame([("s", 16, 1), ("l", 64, None), (None, 5, 1), ("none", 0, 0)], "container_kind string, capacity_tokens bigint, separator_tokens bigint")
    for shard_rows in (1, 50_000):
        rows = packed(docs, boxes, shard_rows=shard_rows).collect()
        whole = {}
        for r in rows:
            whole[r.container_kind, r.doc_id] = whole.get((r.container_kind, r.doc_id), 0) + r.tokens
        assert {i for _, i in whole} == {1, 2, 5} and {k for k, _ in whole} == {"s", "l"}
        assert whole["s", 2] == whole["l", 2] > 16 and whole["s", 1] == 3
        assert all(r.part == 0 for r in rows if r.container_kind == "l")
    rates = {r.container_kind: r for r in fill_rates(docs, boxes).collect()}
    assert all(r.containers >= r.containers_bound and 0 < r.fill <= 1 for r in rates.values()) and len(rates) == 2
    assert packed(docs.limit(0), boxes).count() == 0 and packed(docs, boxes.limit(0)).count() == 0
