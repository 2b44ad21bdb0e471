"""Edge values of the core operators: limits that count and limits that don't, ties, nulls, empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from granary.operators import assets, caches, changes, issues, measures, rules


def test_leak_candidates(spark):
    base = spark.createDataFrame([("grow", 10_000, 1, "other"), ("slow", 10_001, 1, "other"), ("small", 100, 1, "other"), ("gone", 1, 1, "other"), ("same", 5, 1, "other"), ("held", 5, 1, "other")], "object_id string, size bigint, retained bigint, type string")
    target = spark.createDataFrame(
        [("grow", 15_001, 1, "other"), ("slow", 15_001, 1, "other"), ("small", 5_100, 1, "other"), ("same", 5, 1, "other"), ("held", 5, 2, "other"), ("big", 10_001, 1, "other"), ("edge", 10_000, 1, "other"), ("free", 99_999, 0, "other"), ("comp", 1, 1, "component_instance"), ("comp0", 1, 0, "component_instance")],
        "object_id string, size bigint, retained bigint, type string",
    )
    diff = changes.snapshot_diff(base, target)
    kinds = {r.object_id: r.change for r in diff.collect()}
    assert kinds == {"grow": "changed", "slow": "changed", "small": "changed", "gone": "removed", "held": "changed", "big": "added", "edge": "added", "free": "added", "comp": "added", "comp0": "added"}
    assert {r.object_id for r in changes.leak_candidates(diff).collect()} == {"grow", "big", "comp"}
    assert changes.snapshot_diff(base.limit(0), target.limit(0)).count() == 0


def test_leak_patterns(spark):
    rows = [("dom_node", 10_000, "", False, "medium"), ("dom_node", 10_001, "", False, "high"), ("component_instance", 50_000, "", False, "high"), ("component_instance", 50_001, "", False, "critical"), ("closure", 20_000, "", False, "medium"), ("closure", 20_001, "", False, "high"), ("map", 100_000, "", True, "medium"), ("map", 100_001, "", True, "high"), ("set", 100_001, "", False, "medium"), ("array", 60_000, "", False, "high"), ("other", 1, "AppContext", False, "medium"), ("other", 1, "ReduxX", False, "medium"), ("other", 1, None, False, "low")]
    df = spark.createDataFrame(rows, "kind string, size bigint, name string, growing boolean, want string")
    got = df.select("want", changes.leak_pattern(F.col("kind"), F.col("size"), F.col("name"), F.col("growing")).alias("p")).collect()
    assert [r.p.severity for r in got] == [r.want for r in got]
    assert [r.p.pattern for r in got][6:] == ["growing_collection", "growing_collection", "large_cache", "other", "context_reference", "redux_store", "other"]
    f = spark.range(1).select(changes.leak_features(F.lit("closure"), F.create_map(F.lit("cyclic"), F.lit("true"), F.lit("missing_deps"), F.lit("true"))).alias("f"), changes.leak_features(F.lit("timer"), F.lit(None).cast("map<string,string>")).alias("none"), changes.confidence(F.array(F.lit("a"))).alias("c")).first()
    assert (f.f, f.none, f.c) == (["closure_cycle", "effect_dependencies"], [], 0.125)


ISSUES = "issue_id bigint, file_id bigint, rule_id string, severity int, fixable boolean, loc struct<start_line int>"


def test_issue_filters(spark):
    df = spark.createDataFrame([(1, 1, "a", 2, True, (3,)), (1, 1, "a", 2, True, (3,)), (2, 1, "b", 3, None, (4,)), (3, 2, None, 1, False, None), (4, None, "a", 0, False, (1,))], ISSUES)
    once = issues.distinct_issues(df)
    assert once.count() == 4 and {r.issue_id for r in issues.at_least(once, 2).collect()} == {1, 2}
    c = issues.counts(once).first()
    assert (c.total, c.info, c.warning, c.error, c.critical, c.fixable) == (4, 1, 1, 1, 1, 1)
    assert tuple(issues.counts(once.limit(0)).first()) == (0, 0, 0, 0, 0, 0)
    assert [issues.exit_code(x).first()[0] for x in (once, once.filter("severity < 3"), once.filter("severity < 2"), once.limit(0))] == [2, 1, 0, 0]
    assert [r.issue_id for r in issues.ranked(once.filter("file_id is not null"), 2).collect()] == [2, 1]
    files = spark.createDataFrame([(1, "x\n// scan-disable-next-line a, c\ny\nz // scan-disable-line all")], "file_id bigint, source_code string")
    off = issues.suppressions(files, "scan-disable")
    assert {tuple(r) for r in off.collect()} == {(1, 3, "a"), (1, 3, "c"), (1, 4, "all")}
    assert {r.issue_id for r in issues.unsuppressed(once, off).collect()} == {3, 4}


def test_rules_and_settings(spark):
    r = spark.createDataFrame([("x/a", "security", "HIGH", ["react"]), ("x/b", "memory", "info", []), ("y", None, None, None)], "rule_id string, category string, severity string, frameworks array<string>")
    assert {x.rule_id for x in issues.rules_at_or_above(r, "high").collect()} == {"x/a"} and {x.rule_id for x in issues.rules_for(r, "react").collect()} == {"x/a"}
    own = spark.createDataFrame([("x/b", True, "low")], "rule_id string, enabled boolean, severity string")
    cat = spark.createDataFrame([("memory", False, None), ("security", False, None)], "category string, enabled boolean, severity string")
    assert {(x.rule_id, x.severity) for x in issues.configured(r, own, cat).collect()} == {("x/b", "low"), ("y", None)}
    t = spark.createDataFrame([("x", "short"), ("x/a", "long")], "prefix string, suggestion string")
    assert {(x.rule_id, x.suggestion) for x in issues.suggestion_by_prefix(r, t).collect()} == {("x/a", "long"), ("x/b", "short")}
    m = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "a", 3), ("k", "b", 4), ("k", None, 0), ("j", "z", 9)], "key string, v string, n int")
    assert {tuple(x) for x in issues.mode(m, "key", "v", "n").collect()} == {("k", "b", 2), ("j", "z", 1)}


def test_text_rules(spark):
    rule = rules.TextRule("r", 2, "eval(").when(rules.contains("eval(")).unless(rules.matches("(?i)safe"))
    df = spark.createDataFrame([(1, "a\n  eval(x)"), (2, "eval(x) // SAFE"), (3, None), (4, "")], "file_id bigint, source_code string")
    assert [tuple(r) for r in rules.findings(df, [rule]).collect()] == [(1, "r", 2, 2, 3, "a\n  eval(x)")]
    unused = rules.unused_imports(spark.createDataFrame([(1, "import a from 'x';\nimport * as b from 'y';\nimport { c } from 'z';\nb.d()"), (2, None)], "file_id bigint, source_code string"))
    assert [tuple(r) for r in unused.collect()] == [(1, "x", "a")]
    found = rules.imports(spark.createDataFrame([(1, "import a from 'x/y';\r\nimport b from \"x\";\nimport 'x';\nb()")], "file_id bigint, source_code string"))
    assert {(r.source, r.times) for r in rules.duplicate_imports(found).collect()} == {("x", 2)}
    assert {(r.source, r.library) for r in rules.imports_of(found, spark.createDataFrame([("x", 1)], "library string, kb int")).collect()} == {("x/y", "x"), ("x", "x")}


def test_changed_inputs(spark):
    now = spark.createDataFrame([("same", 1, 1), ("newer", 2, 1), ("size", 1, 2), ("older", 1, 1), ("new", 1, 1), ("force", 1, 1)], "path string, mtime bigint, size bigint")
    before = spark.createDataFrame([("same", 1, 1), ("newer", 1, 1), ("size", 1, 1), ("older", 5, 1), ("force", 1, 1), ("gone", 1, 1)], "path string, mtime bigint, size bigint")
    changed = changes.changed_files(now, before, force=["forc"])
    assert {tuple(r) for r in changed.collect()} == {("newer", "newer"), ("size", "size"), ("new", "new"), ("force", "forced")}
    assert {r.path for r in changes.restored(before, now, changed).collect()} == {"same", "older"}
    assert "new" not in {r.path for r in changes.changed_files(now, before, include_new=False).collect()}


def test_measures(spark):
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([("c", t, 1, "update", 3.0), ("c", t, 2, "update", 16.0), ("c", t, 3, "update", 15.0), ("c", t, 4, "mount", 1.0), ("c", t, 5, "update", 0.0), ("c", t, 6, "update", None)], "component string, ts timestamp, event_id int, phase string, took double")
    r = measures.render_stats(e, 16.0).first()
    assert (r.renders, r.most, r.last, r.needless) == (4, 16.0, 1.0, 1)
    m = spark.createDataFrame([(69.9,), (70.0,), (90.0,), (None,)], "v double")
    assert [x.level for x in measures.alerts(m, "v", 70, 90).collect()] == ["warning", "critical"]
    s = spark.createDataFrame([("a", t), ("b", t - dt.timedelta(hours=24)), ("c", t - dt.timedelta(hours=24, seconds=1))], "k string, last timestamp")
    assert {x.k for x in measures.fresh(s, "last", F.lit(t), 24).collect()} == {"a", "b"}
    c = spark.createDataFrame([("s", "n", t + dt.timedelta(seconds=i), i, v) for i, v in enumerate([1.0, 4.0, 2.0, None, 3.0])], "source string, metric_name string, ts timestamp, metric_id int, metric_value double")
    assert [(x.rise, x.restarts) for x in measures.increases(c).collect()] == [(6.0, 1)]


def test_caches_and_assets(spark):
    e = spark.createDataFrame([(f"k{i}", 40, float(i)) for i in range(10)] + [("null", None, 0.5)], "key string, size bigint, last_access double")
    drop = {r.key for r in caches.over_capacity(e, 300).collect()}
    assert drop == {"k0", "null", "k1", "k2", "k3"}
    assert caches.over_capacity(e, 500).count() == 0 and caches.over_capacity(e.limit(0), 1).count() == 0
    assert {r.key for r in caches.over_capacity(e, 300, buckets=1).collect()} == drop
    p = spark.createDataFrame([(10, 0.0, 0, 0.0), (0, 86_400.0, 1_048_576, 604_800.0), (20, 0.0, None, 0.0)], "hits int, idle double, size bigint, age double")
    assert [round(r[0], 9) for r in p.select(caches.priority(F.col("hits"), F.col("idle"), F.col("size"), F.col("age"))).collect()] == [1.0, 0.0, 1.0]
    assert {r.key for r in caches.expired(e, F.lit(9.5), F.lit(9.0)).collect()} == {"k0"}
    ring = caches.ring([("a", 1), ("b", 1)], 4)
    assert [x.n for x in spark.createDataFrame([(ring[0][0],), (ring[0][0] + 1,), (ring[-1][0] + 1,)], "h bigint").select(caches.routed(F.col("h"), ring).alias("n")).collect()] == [ring[0][1], ring[1][1], ring[0][1]]
    a = spark.createDataFrame([("x.js", 100), ("y.css", 101), ("z.js.map", 1)], "path string, size bigint")
    assert {r.path for r in a.filter(assets.is_asset(F.col("path"))).collect()} == {"x.js", "y.css"} and {r.path for r in assets.oversize(a, 100).collect()} == {"y.css"}
    names = spark.createDataFrame([("node_modules/@a/b/c.js",), ("x/node_modules/d/e.js",), ("src/f.js",)], "path string").select(assets.package_name(F.col("path")).alias("n")).collect()
    assert [r.n for r in names] == ["@a/b", "d", None]
    assert tuple(assets.totals(a.limit(0), 1).first()) == (0, 0, 0, 0)
