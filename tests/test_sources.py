"""Scans, JSON documents, settings, safe writes, reports and scalar functions."""

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.sources import files as S


def test_scan_reads_known_extensions_and_skips_folders(spark, tmp_path):
    for path, text in {"src/a.ts": "let a", "src/b.css": "x", "node_modules/c.js": "c", "lib/dist/d.js": "d", "e.VUE": "e", "src/f.vue": "ä\n", "src/g.test.js": "g"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {r.file_path: r.source_code for r in S.scan(spark, str(tmp_path), ignore=["*.test.js"]).collect()}
    assert got == {"src/a.ts": "let a", "src/f.vue": "ä\n"}
    rules = spark.createDataFrame([("a.rule.ts",), ("b.rule.test.ts",), ("c.ts",), ("d.rule.js",)], "file_path string")
    assert {r[0] for r in S.rule_files(rules).collect()} == {"a.rule.ts", "d.rule.js"}


def test_json_settings_and_swap(spark, tmp_path):
    assert S.json_or(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "x.json").write_text('{"a": 1}')
    assert S.json_or(spark, str(tmp_path / "x.json"), "a int").collect()[0].a == 1
    assert S.settings({"a": 1, "b": {"c": 1, "d": [1]}}, None, {"b": {"d": [2]}, "e": 3}) == {"a": 1, "b": {"c": 1, "d": [2]}, "e": 3}
    target = str(tmp_path / "t")
    S.swap_in(spark.range(3), target)
    S.swap_in(spark.read.parquet(target).union(spark.range(2)), target)  # reads what it replaces
    assert spark.read.parquet(target).count() == 5
    assert [r[0] for r in S.as_json(spark.createDataFrame([(1, None)], "a int, b string")).collect()] == ['{"a":1,"b":null}']


def test_reports_and_console():
    page = S.html_report("a<b", {"n": 1}, [("x&y", None)], ("k", "v"))
    assert "a&lt;b" in page and "x&amp;y" in page and "<td></td>" in page
    assert S.pretty({"a": [1]}) == '{\n  "a": [\n    1\n  ]\n}'


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_functions(spark):
    lit = F.lit
    cases = [
        (T.format_bytes(lit(1536)), "1.5 KB"), (T.format_bytes(lit(0)), "0 Bytes"), (T.format_bytes(lit(1024)), "1 KB"), (T.format_bytes(lit(1023)), "1023 Bytes"), (T.format_bytes(lit(5 * 1024**3)), "5 GB"), (T.format_bytes(lit(None).cast("bigint")), "0 Bytes"),
        (T.truncate(lit("abcdef"), 3), "abc..."), (T.truncate(lit("abc"), 3), "abc"), (T.html_escape(lit("<a b=\"c\">&'")), "&lt;a b=&quot;c&quot;&gt;&amp;&#039;"),
        (T.text_hash(lit("hello")), 99162322), (T.text_hash(lit("")), 0), (T.text_hash(lit("a long text that overflows")), abs(__import__("ctypes").c_int32(__import__("functools").reduce(lambda h, c: (h * 31 + ord(c)) & 0xFFFFFFFF, "a long text that overflows", 0)).value)),
        (T.next_version(lit("1.2.3")), "1.3.0"), (T.next_version(lit("1.2.3"), True), "2.0.0"), (T.next_version(lit("x")), "1.0.0"), (T.next_version(lit(None).cast("string")), "1.0.0"),
        (T.extension(lit("a/B.TSX")), ".tsx"), (T.extension(lit("a.b/c")), ""), (T.basename(lit("a/b.c")), "b.c"), (T.dirname(lit("a/b/c")), "a/b"), (T.dirname(lit("a")), "."), (T.relative(lit("/r/a/b"), lit("/r/")), "a/b"),
        (T.line_at(lit("ab\ncd"), lit(4)), 2), (T.column_at(lit("ab\ncd"), lit(5)), 2), (T.offset_at(lit("ab\ncd\ne"), lit(3), lit(1)), 7), (T.replaced_range(lit("abcdef"), lit(2), lit(4), lit("X")), "aXdef"), (T.replaced_range(lit("ab"), lit(2), lit(2), lit("X")), "aXb"),
        (T.fill_template(lit("{a} {b}"), F.create_map(lit("a"), lit("1"))), "1 {b}"), (T.excluded(lit("a\\node_modules\\b.js"), ["node_modules/"]), True), (T.excluded(lit("src/a.test.js"), ["*.test.js"]), True), (T.excluded(lit("src/atest.js"), ["*.test.js"]), False),
        (S.console_level(lit("[SECURITY] HIGH x")), "high"), (S.console_level(lit("[SECURITY] x")), "medium"), (S.console_level(lit("x")), None),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert [row[f"c{i}"] for i in range(len(cases))] == [v for _, v in cases]
