"""Rules on single files, vendored copies by digests, and the defined results of edge cases."""

import pytest

from granary.llm.handwritten import header_rules, layout_rules, not_handwritten, repeats_itself

HAND = "import x from './y';\n\nexport function measure(a) {\n  if (!a || a.id > 83) {\n    return null;\n  }\n  const b = a.target ?? 4800;\n  return b + 1;\n}\n"


STEPS = ["const part = value.items[{n}] ?? {n};", "if (!value || value.id > {n}) {{ return null; }}", "value.on('x', (ev) => ev.y + {n});", "let k = 0; while (k < {n}) {{ k += 2; }}", "try {{ value.run({n}); }} catch (e) {{ console.warn(e); }}", "switch (value.kind) {{ case {n}: break; }}"]


def library(seed, functions=8):
    """A library whose functions all differ, so that no rule on a single file finds it."""
    body = lambda i: "\n".join("  " + STEPS[(i * k + k) % 6].format(n=seed * 100 + i) for k in range(1, 3 + i % 4))
    return "".join(f"function lib{seed}x{i}(value) {{\n{body(i)}\n  return value * {i + seed};\n}}\n" for i in range(functions))


@pytest.mark.parametrize(
    ("path", "text", "made"),
    [
        ("src/a.ts", "/* eslint-disable */\n/* This file was written automatically from a.schema; your changes will be lost. */\n" + HAND, True),
        ("src/a.ts", "// Code generated by x-gen v2.0. DO NOT EDIT.\n" + HAND, True),
        ("src/a.ts", "/**\n * @generated SignedSource<<aa>>\n */\n" + HAND, True),
        ("src/a.ts", '// Writes the file that says "generated, do not edit" for the client.\n' + HAND, False),
        ("src/a.ts", "// Handles auto-generated answer ids; this module itself is maintained by us.\n" + HAND, False),
        ("src/a.ts", "// v3.3.4 of our mixer wrapper around the vendor bundle\n" + HAND, False),
        ("src/a.ts", "/**\n * Copyright (c) 2016 Basil team. All rights reserved.\n */\n" + HAND, False),
        ("src/a.ts", HAND + "// Code generated by x. DO NOT EDIT.\n", False),
        ("gen/a.ts", HAND, True),
        ("src/generators/vendors/a.ts", HAND, False),
        ("package-lock.json", '{\n "lockfileVersion": 3\n}', True),
        ("node_modules/a/index.js", HAND, True),
        ("src/a.js", "/*! quill v1.2.3 | (c) the quill authors | MIT */\n" + HAND, True),
        ("src/a.js", "", False),
    ],
)
def test_header_rules(path, text, made):
    assert header_rules(path, text) is made


def test_layout_rules():
    assert layout_rules("a.js", "!function(e,t){" + "e.x=t.y?1:2;try{f(e)}catch(r){n=3}" * 20 + "}(1,2);")
    assert layout_rules("a.js", 'export const a = "' + "QUJD/" * 200 + '";')
    assert layout_rules("a.js", "export default [\n" + "  0x6c, 0x4d, 0xbd,\n" * 60 + "];\n")
    assert not layout_rules("a.js", HAND * 4)
    assert not layout_rules("a.json", "[" + "1," * 500 + "1]")
    assert not layout_rules("a.js", HAND + 'const LONG = "' + "lumen violet " * 60 + '";\n')
    assert not layout_rules("a.js", "const small = {\n  a: 1,\n  b: 2,\n};\n")
    assert repeats_itself("a.js", "".join(f"export const op_{i} = (args) =>\n  request('GET', '/v{i}', args);\n" for i in range(20)))
    assert not repeats_itself("a.js", HAND * 3)
    assert not repeats_itself("a.js", "".join(f".a{i} {{\n  margin: {i}px;\n}}\n" for i in range(20)))


NAMES = "AMBER BASIL CEDAR DELTA EAGLE FJORD GROVE HARBOR ISLAND JASPER KNOLL LUMEN MAPLE NIMBUS ONYX PEBBLE QUIVER RIDGE".split()
TABLES = "".join(f"export const Table{i} = Object.freeze({{\n" + "".join(f"  {name}_{k}: '{i * 31 + k:06x}',\n" for k, name in enumerate(NAMES)) + "});\n" for i in range(4))
VARIED = "".join(STEPS[i % 6].format(n=i).replace("value", f"{name.lower()}{i}") + "\n" for i, name in enumerate(NAMES * 4))


def test_all_lines_count_for_the_form():
    calls = "".join(f"export const op_{i} = (args) => request('GET', '/v{i}', args);\n" for i in range(900))
    assert repeats_itself("a.js", TABLES)  # entries that begin in many ways
    assert repeats_itself("a.js", "".join(f"{name.lower()}({i}).{name} = [{i}, '{name}'];\n" for i, name in enumerate(NAMES * 4)) + calls)  # the form begins late
    assert not repeats_itself("a.js", calls[:4000] + VARIED)  # and ends early
    assert not repeats_itself("a.js", VARIED + TABLES)


def test_lock_version_stands_anywhere():
    packages = '"packages": {' + ", ".join(f'"p{i}": {{"version": "{i}.0.0"}}' for i in range(60)) + "}"
    assert header_rules("deps.json", "{" + packages + ', "lockfileVersion": 3}')
    assert header_rules("deps.json", '{\n "name": "cut off,\n ' + packages + ', "lockfileVersion": 3')
    assert not header_rules("deps.json", "{" + packages + ', "schema": {"lockfileVersion": {"type": "integer"}}}')
    assert not header_rules("deps.json", "{" + packages + ', "needs": "lockfileVersion"}')


SCHEMA = "file_id bigint, repo string, file_path string, source_code string"


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as folder", "2 as share", "3 as digest")
    return {r.file_id for r in not_handwritten(df).collect()}


def test_vendored_copies_across_repositories(spark):
    patched = library(1).replace("value * 3", "value * 33")
    stripped = "\r\n".join("    " + line for line in library(1).split("\n"))
    rows = [
        (1, "a", "lib/one.js", library(1)),
        (2, "b", "src/other.js", "// ours\n" + patched),
        (3, "c", "x.js", stripped),
        (4, "a", "src/own.js", library(2)),
        (5, "a", "src/own.js", library(2)),  # scanned again: the same repository
        (6, "d", "src/mix.js", library(3, 8) + library(1, 1)),
        (7, "d", "src/n.js", None),
        (None, "e", "src/own.js", library(1)),
        (8, "e", None, HAND),
        (9, None, "src/z.js", HAND.replace("measure", "other")),
        (10, "e", "src/empty.js", ""),
        (11, "f", "src/empty.js", ""),
    ]
    assert found(spark, rows) == {1, 2, 3}
    assert found(spark, rows + rows) == {1, 2, 3}
    assert found(spark, []) == set()


def test_equal_folders(spark):
    tree = {"theirs/a.json": '{"a": [' + "1, " * 60 + "2]}", "theirs/sub/b.json": '{"b": [' + "3, " * 60 + "4]}"}
    rows = [(i * 10 + j, f"r{i}", f"p{i}/{p}", t) for i in range(2) for j, (p, t) in enumerate(tree.items())]
    assert found(spark, [*rows, (99, "r1", "p1/own.js", HAND)]) == {0, 1, 10, 11}


def test_forms_are_found_whole(spark):
    rows = [(1, "a", "src/tables.js", TABLES), (2, "a", "src/steps.js", VARIED), (3, "a", "src/mixed.js", VARIED + TABLES)]
    assert found(spark, rows) == {1}
