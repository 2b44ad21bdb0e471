"""Shared spans against brute force, and the edge cases of the docstrings."""

import random

import pytest

from granary.llm.spans import shared_spans, shared_share, unit_duplicates


def brute(rows, least):
    found = set()
    for a, x in rows:
        grams = {x[i : i + least] for i in range(len(x or "") - least + 1)}
        for b, y in rows:
            if a < b and any(y[i : i + least] in grams for i in range(len(y or "") - least + 1)):
                found.add((a, b))
    return found


def pairs(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {tuple(r) for r in shared_spans(df, **options).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_every_pair_and_no_other(spark, seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("ab\n 本😀c") for _ in range(n))
    parts = [make(rng.choice([38, 39, 40, 41, 60])) for _ in range(6)]
    rows = [(i, make(rng.randrange(30)) + (rng.choice(parts) if rng.random() < 0.7 else "") + make(rng.randrange(30))) for i in range(60)]
    assert pairs(spark, rows, min_chars=40, unit=24) == brute(rows, 40)
    assert pairs(spark, rows, min_chars=40, unit=40) == brute(rows, 40)


def test_repetitive_nulls_copies_and_clashing_columns(spark):
    rows = [(1, "a" * 60), (2, "a" * 50), (3, None), (None, "a" * 60), (4, ""), (5, "a" * 39), (6, "x" * 60), (7, "x" * 60), (7, "x" * 60)]
    assert pairs(spark, rows, min_chars=40, unit=24) == {(1, 2), (6, 7)}
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as _text", "2 as _id", "3 as doc_a")
    assert {tuple(r) for r in shared_spans(df, min_chars=40, unit=24).collect()} == {(1, 2), (6, 7)}
    assert pairs(spark, [], min_chars=40, unit=24) == set()
    with pytest.raises(ValueError):
        pairs(spark, rows, min_chars=40, unit=41)


def test_units_keep_the_earliest_and_give_original_offsets(spark):
    line = "x" * 20 + "  " + "y" * 20
    rows = [(1, f"head\n{line}\ntail"), (2, f"{line.replace('  ', ' ')}\r\nmore"), (3, f"\n\n{line}\n{line}"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in unit_duplicates(df).collect())
    assert got == [(2, 0, 42, 1, 5), (3, 2, 42, 1, 5), (3, 45, 42, 1, 5)]
    assert {r.doc_id: r.shared_chars for r in shared_share(df).collect()} == {2: 42, 3: 84}
