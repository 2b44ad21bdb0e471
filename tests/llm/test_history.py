"""Repeated reports: volatile details, other components, batches one by one, skew and empty input."""

import pytest

from granary.llm.history import ACCEPTED, Segment, accept_batch, differing, merged_reports, repeated_reports

SCHEMA = """info_id bigint, batch_no int, description string, component string, loc struct<file_path string>, stack string,
    first_detected timestamp, last_detected timestamp, occurrence_count bigint"""
TEXT = "Render of {c} took {n} ms in the local phase, {f} recomputed every comment although nothing changed and {a} was hit for each prairie row, build {n}f4e0a7"


def row(i, batch, c="RecentDriverView", f="detachPantry", a="innerHTML", n=358, path="src/a/retryWorker.ts", text=None, stack=None):
    return (i, batch, (text or TEXT).format(c=c, f=f, a=a, n=n), c, (path,) if path else None, stack, None, None, 2)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as _cell", "2 as _plain", "3 as kept_id")
    return {tuple(r) for r in repeated_reports(df, **options).collect()}


def test_volatile_details_are_one_defect_and_other_names_are_not(spark):
    other = "Interval created in {f} by {c} fires every {n} ms while the issue tab is wide, {a} keeps the delta session alive, object {n}aa"
    rows = [
        row(1, 0),
        row(2, 0, n=7, path="/app/a/retryWorker.ts"),
        row(3, 1, text=TEXT.upper().replace("{C}", "RECENTDRIVERVIEW").replace("{F}", "DETACHPANTRY").replace("{A}", "INNERHTML").replace("{N}", "9")),
        row(4, 1, text="again: " + TEXT.replace("took", "needed").replace("nothing", "nohting"), path=None, stack="    at detachPantry (C:/agent/ws/a/retryWorker.ts:1:2)"),
        row(5, 2, c="OtherDriverView"),
        row(6, 2, a="eval"),
        row(7, 3, path="src/b/retryWorker.ts"),
        row(8, 3, text=other),
        row(9, 4, text=other, n=3),
        (10, 5, None, None, None, None, None, None, None),
        (None, 5, "x", None, None, None, None, None, None),
        (11, 5, " 12 ", None, None, None, None, None, None),
    ]
    assert found(spark, [*rows, rows[1]]) == {(1, 2), (1, 3), (1, 4), (8, 9)}
    assert found(spark, []) == set()


def test_batches_one_by_one_and_all_at_once_agree(spark):
    rows = [row(i, i % 5, c=f"Recent{'ABC'[i % 3]}View", n=i, text=TEXT if i % 2 else TEXT.replace("took", "needed")) for i in range(1, 40)]
    rows = [(*r[:1], r[0] // 10, *r[2:]) for r in rows]
    whole = found(spark, rows)
    for last in range(4):
        some = [r for r in rows if r[1] <= last]
        assert found(spark, some) == {p for p in whole if p[1] in {r[0] for r in some}}


def test_batch_after_batch_against_the_accepted_alone(spark, tmp_path):
    rows = [row(i, i // 8, c=f"Recent{'ABC'[i % 3]}View", n=i, path=None if i % 5 == 0 else "src/a/x.ts", text=TEXT if i % 2 else TEXT.replace("took", "needed").upper().replace("{C}", "{c}").replace("{F}", "{f}").replace("{A}", "{a}").replace("{N}", "{n}")) for i in range(1, 33)]
    path = str(tmp_path / "accepted")
    spark.createDataFrame([], ACCEPTED).write.parquet(path)
    got = set()
    for b in range(5):
        links, new = accept_batch(spark.read.parquet(path), spark.createDataFrame([r for r in rows if r[1] == b], SCHEMA))
        got |= {(r.kept_id, r.info_id) for r in links.collect() if r.kept_id != r.info_id}
        new.write.mode("append").parquet(path)
    assert got == found(spark, rows) and len(got) == 29
    assert spark.read.parquet(path).count() == 3


def test_merged(spark):
    rows = [row(1, 0), row(2, 1, n=5), row(3, 1, c="OtherDriverView")]
    got = {r.kept_id: (r.reports, r.occurrence_count) for r in merged_reports(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (2, 4), 3: (1, 2)}


@pytest.mark.parametrize("seed", range(3))
def test_segment_finds_every_run(seed):
    import random

    rng = random.Random(seed)
    records = [(i, [rng.choice("abc") for _ in range(rng.randrange(1, 12))]) for i in range(30)]
    segment = Segment(records)
    for n in (1, 2, 4):
        run = [rng.choice("abc") for _ in range(n)]
        assert segment.run(run) == {no for no, (_, w) in enumerate(records) if any(w[k : k + n] == run for k in range(len(w) - n + 1))}
    assert differing("a b c".split(), "a x c d".split(), 5) == 2
    assert differing(["a"], list("bcdefg"), 2) == 3
