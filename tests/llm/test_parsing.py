"""Accepted and rejected snippets per language, the side by side driver against a plain one, and edge cases."""

import pytest

from granary.scripts.grammar import Tables, build, rules, tables
from granary.scripts.lexer import Lexer
from granary.llm.parsing import rejected_files, rejection_rates
from granary.scripts.parser import SCRIPTS, errors, extension, parse_all

GOOD = {
    "js": [
        "", "#!/usr/bin/env node\nimport a, { b as c, default as d } from 'x';\nimport * as e from \"y\";\nexport { c as default };\nexport * from 'z'",
        "const { a: b = 1, ...rest } = x, [c, , d = 2, ...e] = y\nlet f\nf = a\n++b\nc\n(d)",
        "for (const x of y) z(x);\nfor (let i = 0, n = 3; i < n; i++) {}\nfor (k in o) continue\nfor (;;) { break }\nasync () => { for await (const x of y) ; }",
        "if (a) b; else if (c) d\nelse { e }\ndo x++; while (x < 5) y()\nwhile (1) z\nswitch (a) { case 1: case 2: { b() } default: c }\nlabel: for (;;) { break label }",
        "try { a } catch { b }\ntry { a } catch ({ message }) { b } finally { c }\nthrow new Error(`x ${a + `${b}`} y`)",
        "class A extends B(c) { static #x = 1; y = 2\n static { z() } get w() { return 1 } set w(v) {} async *gen() { yield* a; yield } 'quoted'() {} [computed]() {} constructor() { super(); } static async = 3 }",
        "x = { a, b: 1, c() {}, get d() { return 1 }, async e() {}, *f() {}, 'g': 2, [h]: 3, ...i, if: 4, get: 5, async: 6, set() {} };\n({ a: b } = c);\n[a, b] = [b, a]",
        "a = b ? c : d ? e : f; a ??= b?.[c]?.d?.(e) ?? f; g = typeof -a ** 2; h = !/[/]\\/x/gi.test(i) / 2",
        "const f = (a, { b } = {}, ...c) => ({ d: a }), g = async x => await x, h = async (y) => { return y }, i = function* () {}, j = class {}\nexport default function () {}",
        "export const a = 1, b = 2\nexport function c() {}\nexport async function d() {}\nexport class E {}\nexport default { x: 1 }",
        "var a = 0xFF + 0b11 + 0o7 + 1e3 + .5 + 1_000n\nimport('x').then(y => y)\nnew.target\nnew (a.b)(c)\nnew a.b\nnew a()()\nimport.meta.url\ndebugger",
        "return_ = 1\nvar of = 1, get = 2, from = 3, as = 4, type = 5, async = 6\n;[1].map(x => x)\na\n/b/g\nif (x) /re/.test(y)",
        "a = x /* c */ / y // d\n/ z",
    ],
    "jsx": ["const a = <div className=\"x\" {...p} on:click={() => 1}>text {a && <b>{'s'}</b>} {/* c */} <A.B c /> it's</div>;\nfunction F() { return (<>\n<br/>&nbsp;</>); }\nconst c = a < b ? <i/> : d"],
    "ts": [
        "const a: Record<string, number> = {}, b = c as unknown as D<E>, d = e!.f, g = <any>h\nlet x: (a: string) => void, y: string[] | null = null",
        "export interface A<T extends B = C> extends D { a?: string; readonly b: T[]; [key: string]: any; c(x: number): void; new (y): A }\ntype F<T> = { [K in keyof T]?: T[K] } & (G | 'lit' | 3)\ntype H = T extends infer U ? U : never",
        "class A<T> implements B, C { private readonly x: number = 1; constructor(private y: string, public z?: T) { super() } get a(): any { return 1 } static b?: string; abstract c(): void; d!: T }\nabstract class Z {}",
        "function f<T>(this: any, a?: T, ...b: string[]): a is string { return useState<T>(a) }\nconst g = async <T>(x: T): Promise<T> => x, h = (a: number, b = 2): [string, number?] => c\nfunction over(a: string): void\nfunction over(a) {}",
        "enum E { A = 1, B, 'c' = 2 }\ndeclare module 'x' { const y: number }\nnamespace N.M { export const a = 1 }\nexport type { T } from 'y'\nimport type { U } from 'z'\nimport { type V, W } from 'q'",
        "const a = b < c && d > (e), f = x satisfies Y\nfor (const k of m.get<string>(n) ?? []) {}\nexport const fn = (p: any): any => { return p }\nlet v = q ? (r) : s",
    ],
    "tsx": ["export function A({ a }: any) { const [b, setB] = useState<any>([]); return (<p title=\"x\">{a ? <b>y</b> : null}</p>) }\nconst g = <T,>(x: T) => x"],
    "json": ['{"a": [1, 2.5e3, null, true, "x"]}', " 3 ", "[]"],
    "vue": ["<template><p v-if=\"a > 2\">{{ x }}</p></template>\n<script>\nexport default { a: 1 }\n</script>", "<template/>"],
    "env": ["not ( a script"],
}
BAD = {
    "js": [
        "a b", "const = 1", "function f( {", "if (a > ) {}", "return x..y", "{", "}", "(", "a ]", "x = 'open", "`open ${a", "/* open", "const a: string = 1", "interface A { b: string }", "x = <div/>", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x",
        ".a {\n margin: 1px;\n}", "# title", "<!DOCTYPE html>", "for (const x off y) {}", "const o = { a: 1\n b: 2 }", "const o = { a = 1 }", "fucntion f() {}", "x = ‘a’", "let x == 1", "a => {} b", "import { a } form 'x'", "class A { b( }",
        "case 1: x", "else {}", "3px", "x = /(/", "'\\x1'", "def f(a) {\n}", "function f(a: any) {}", "var x = 08", "await = 1",
    ],
    "jsx": ["x = <a></b>", "x = <a>", "x = <a b=c/>", "x = <a>}</a>", "const a: any = <b/>"],
    "ts": ["const x: = 1", "interface A { a: }", "x = <div>{a}</div>", "function f(a: any {}", "type A = ", "enum E { A B }", "const o = {\n a: 'x'\n b: 1,\n};", "class A { foo(: any) {} }"],
    "json": ["", "{'a': 1}", '{"a": 1,}', "{} {}", "NaN", "// c\n{}", "a: 1"],
    "vue": ["<script>\nlet x == ;\n</script>", "<script>\nconst a: any = 1\n</script>"],
}


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, all_ in GOOD.items() for t in all_])
def test_accepted(ext, text):
    assert errors([f"a.{ext}", f"a.{ext}"], [text, text.replace("\n", "\r\n")]) == [None, None]


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, all_ in BAD.items() for t in all_])
def test_rejected(ext, text):
    assert errors([f"a.{ext}"], [text])[0] is not None


def plain(tokens, line_before, table):
    """One file at a time, with lists."""
    stack, i, waiting = [0], 0, False
    while True:
        name = "ASI" if waiting else tokens[i]
        act = int(table.action[stack[-1], table.terminals.get(name, 1)])
        if act == 0 and not waiting and (line_before[i] or tokens[i] in ("}", "EOF")):
            waiting = True
            continue
        if act == 0:
            return i
        if act == Tables.ACCEPT:
            return -1
        if act > 0:
            stack.append(act - 1)
            i, waiting = i + (not waiting), False
        else:
            del stack[len(stack) - int(table.rule_length[-act]) :]
            stack.append(int(table.goto[stack[-1], table.rule_left[-act]]))


@pytest.mark.parametrize("typed", [False, True])
def test_side_by_side_equals_one_by_one(typed):
    texts = [t for e, all_ in [*GOOD.items(), *BAD.items()] for t in all_ if e in SCRIPTS and SCRIPTS[e][0] == typed]
    texts += ["f(" * 300 + ")" * 300, "f(" * 300 + ")" * 299, "f(" * 3000 + ")" * 3000, "x = [" * 3000 + "1" + "]" * 2999] + ["a(b);\n" * k for k in range(60)]
    lexed = [Lexer(t, typed, True) for t in texts]
    assert parse_all(lexed, tables(typed)).tolist() == [plain(x.tokens, x.line_before, tables(typed)) for x in lexed]


def test_error_line_and_tables():
    assert errors(["a.js", "b.json", "c.vue"], ["a\n\nb c", '{\n"a": 1,\n}', "<template>\n</template>\n<script>\nx\ny z\n</script>"]) == [3, 2, 5]
    assert extension("src/.env") == "env" and extension("a/b") == ""
    assert rules("a : b c | ;\nd : e ;") == [("a", ("b", "c")), ("a", ()), ("d", ("e",))]
    small = build("program : program x | x ;")
    assert small.conflicts == () and small.action.shape[1] == 3


def test_table(spark):
    rows = [(1, "r", "a.js", "js", "a b"), (1, "r", "a.js", "js", "a b"), (2, "r", "a.js", "js", ""), (3, None, "b.json", None, ""), (4, "r", "c.js", "js", None), (5, "r", None, "js", "a b"), (None, "r", "a.js", "js", "a b"), (6, "r", ".env", None, "( a"), (7, "r", "B.TSX", None, "<a>")]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, file_path string, lang string, source_code string").selectExpr("*", "1 as error_line", "2 as ext")
    assert {tuple(r) for r in rejected_files(df).collect()} == {(1, 1), (3, 1), (7, 1)}
    assert {tuple(r) for r in rejection_rates(df).collect()} == {("r", "js", 2, 1, 0.5), (None, None, 1, 1, 1.0), ("r", None, 1, 1, 1.0)}
    assert rejected_files(df.limit(0)).count() == 0
