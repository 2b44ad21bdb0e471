"""Scripts as a table of nodes, and rules on nodes as filters, joins and anti-joins.

nodes: file_id, no, kind (call, assign, import, function, class, element, attribute, string, template), name, value,
line_no, column_no, scope (no of the innermost function, -1 outside), guarded (inside if, switch, ? or a catch of that
scope), looped (inside a loop or the callback of one).  A file that its grammar rejects has no nodes but one row of
kind ``error``, so a failure is a row and never an exception.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.scripts.grammar import tables
from granary.scripts.lexer import Lexer
from granary.scripts.parser import SCRIPTS, blocks, extension, parse_all

SCHEMA = "file_id bigint, no int, kind string, name string, value string, line_no int, column_no int, scope int, guarded boolean, looped boolean"
_EACH = frozenset("map forEach filter reduce some every flatMap".split())


def _word(text: str, at: int) -> str:
    m = re.compile(r"#?[\w$]+|\"[^\"]*\"|'[^']*'").match(text, at)
    return m[0] if m else ""


def _chain(x: Lexer, i: int) -> str:
    """The dotted name that ends at token i."""
    parts = [_word(x.text, x.starts[i])]
    while i > 1 and x.tokens[i - 1] in (".", "?.") and x.tokens[i - 2] in ("IDENT", "KEY"):
        i -= 2
        parts.append(_word(x.text, x.starts[i]))
    return ".".join(reversed(parts))


def nodes_of(x: Lexer) -> list[tuple]:
    """(kind, name, value, offset, scope, guarded, looped) of a token list in its order; no of a node is its place here."""
    out: list[tuple] = []
    tokens, starts, text = x.tokens, x.starts, x.text
    stack: list[tuple[str, int, bool, bool]] = []  # open bracket: kind, scope, guarded, looped
    scope, guarded, looped = -1, False, False
    last_function = -1
    pending = ""  # what the next block belongs to
    element: list[int] = []
    for i, t in enumerate(tokens):
        prev = tokens[i - 1] if i else ""
        if t in ("IF", "ELSE", "SWITCH", "CATCH"):
            pending = "guard"
        elif t in ("FOR", "WHILE", "DO"):
            pending = "loop"
        elif t == "FUNCTION" or t == "=>":
            pending = "function"
        if t in ("(", "ALP"):
            if prev in ("IDENT", "KEY") and (i < 2 or tokens[i - 2] not in ("FUNCTION", "CLASS")) and prev == "IDENT":
                name = _chain(x, i - 1)
                first = _word(text, starts[i + 1]) if i + 1 < len(tokens) else ""
                out.append(("call", name, first, starts[i - 1], scope, guarded, looped))
                stack.append(("call:" + name.rpartition(".")[2], scope, guarded, looped))
            else:
                if prev == "KEY":
                    last_function = len(out)
                    out.append(("function", _word(text, starts[i - 1]), "method", starts[i - 1], scope, guarded, looped))
                    pending = "function"
                stack.append(("(", scope, guarded, looped))
        elif t == "[" or t == "OB" or t == "JB" or t in ("TPLH",):
            stack.append((t, scope, guarded, looped))
            if t == "TPLH":
                end = text.find("`", starts[i] + 1)
                out.append(("template", "", text[starts[i] : end + 1 if end > 0 else len(text)][:400], starts[i], scope, guarded, looped))
        elif t == "LB":
            stack.append(("LB", scope, guarded, looped))
            if pending == "function":
                each = any(k.startswith("call:") and k[5:] in _EACH for k, *_ in stack[-3:])
                scope, guarded, looped = last_function, False, each
            elif pending == "guard":
                guarded = True
            elif pending == "loop":
                looped = True
            pending = ""
        elif t in (")", "]", "}", "TPLT"):
            if stack:
                _, scope, guarded, looped = stack.pop()
        elif t in ("=", "AOP") and prev in ("IDENT", "]"):
            if prev == "IDENT":
                j = i - 1
                while j > 1 and tokens[j - 1] in (".", "?."):
                    j -= 2
                if tokens[j - 1 : j] != ["VAR"] and j < i - 1:
                    out.append(("assign", _chain(x, i - 1), _word(text, starts[i + 1]) if i + 1 < len(tokens) else "", starts[i - 1], scope, guarded, looped))
        elif t == "STR":
            if prev in ("FROM", "IMPORT"):
                out.append(("import", _word(text, starts[i])[1:-1], "", starts[i], scope, guarded, looped))
            elif prev == "=" and i > 1 and tokens[i - 2] == "JNAME":
                pass
            else:
                out.append(("string", "+" if tokens[i + 1 : i + 2] == ["+"] or prev == "+" else "", _word(text, starts[i])[1:-1][:400], starts[i], scope, guarded, looped))
        elif t == "JNAME":
            if prev == "JLT":
                element.append(len(out))
                out.append(("element", _word(text, starts[i]), "", starts[i], scope, guarded, looped))
            elif prev not in (".", ":", "JLTS") and element:
                value = _word(text, starts[i + 2]) if tokens[i + 1 : i + 2] == ["="] and i + 2 < len(tokens) else ""
                out.append(("attribute", re.compile(r"[\w$-]+").match(text, starts[i])[0], value.strip("\"'") if value[:1] in "\"'" else "{}", starts[i], element[-1], guarded, looped))
        elif t in ("JSLASH", "JLTS") and element:
            element.pop()
        elif t == "IDENT" and prev in ("FUNCTION", "CLASS") or t == "IDENT" and prev == "*" and i > 1 and tokens[i - 2] == "FUNCTION":
            if prev != "CLASS":
                last_function = len(out)
            out.append(("class" if prev == "CLASS" else "function", _word(text, starts[i]), "", starts[i], scope, guarded, looped))
    return out


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        jobs = []
        for file_id, path, text in zip(pdf["file_id"].tolist(), pdf["file_path"].tolist(), pdf["source_code"].tolist(), strict=True):
            ext = extension(path)
            typed, elements = SCRIPTS[ext]
            jobs += [(file_id, typed, text, offset, Lexer(script, typed, elements)) for script, offset in blocks(text, ext)]
        rows = []
        for typed in (False, True):
            mine = [j for j in jobs if j[1] == typed]
            for (file_id, _, text, offset, x), bad in zip(mine, parse_all([j[4] for j in mine], tables(typed)), strict=True):
                found = nodes_of(x) if bad < 0 else [("error", "", "", x.starts[bad], -1, False, False)]
                breaks = [-1, *(m.start() for m in re.finditer("\n", text))]
                for no, (kind, name, value, at, scope, guarded, looped) in enumerate(found):
                    line = bisect_left(breaks, at + offset)
                    rows.append((file_id, no, kind, name, value, line, at + offset - breaks[line - 1], scope, guarded, looped))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def nodes(files: DataFrame) -> DataFrame:
    """Nodes of every script with an id and code; files of other kinds have none."""
    known = "|".join(SCRIPTS)
    files = files.select("file_id", "file_path", "source_code").filter("file_id is not null and source_code is not null").filter(F.col("file_path").rlike(rf"(?i)\.(?:{known})$"))
    return files.mapInPandas(_rows, SCHEMA)


def _hit(rule_id: str, severity: int, found: DataFrame) -> DataFrame:
    return found.select("file_id", F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), "line_no", "column_no")


def unsafe_html(n: DataFrame) -> DataFrame:
    """Writes of markup: properties, attributes and document.write."""
    last = F.element_at(F.split("name", r"\."), -1)
    return n.filter(((F.col("kind") == "assign") & last.isin("innerHTML", "outerHTML")) | ((F.col("kind") == "attribute") & (F.col("name") == "dangerouslySetInnerHTML")) | ((F.col("kind") == "call") & (F.col("name").isin("document.write", "document.writeln") | (last == "insertAdjacentHTML"))))


def forms_without_token(n: DataFrame) -> DataFrame:
    """Forms that post, in files in which no field or header speaks of a token."""
    forms = n.filter("kind = 'element' and name = 'form'")
    guarded = n.filter((F.col("kind").isin("attribute", "string")) & F.lower(F.col("value")).rlike("csrf|xsrf|_token")).select("file_id").distinct()
    return forms.join(guarded, "file_id", "left_anti")


def unprotected_requests(n: DataFrame) -> DataFrame:
    """Requests that change something, in files that set no protecting header."""
    calls = n.filter((F.col("kind") == "call") & F.col("name").rlike(r"^(?:fetch|axios\.(?:post|put|patch|delete)|\$\.(?:post|ajax))$"))
    guarded = n.filter((F.col("kind") == "string") & F.lower("value").rlike("csrf|xsrf|authorization")).select("file_id").distinct()
    return calls.join(guarded, "file_id", "left_anti")


def joined_sql(n: DataFrame) -> DataFrame:
    """SQL put together from pieces: a string with + beside it, or a template with a substitution."""
    words = F.col("value").rlike(r"(?i)\b(select\s+.+\s+from|insert\s+into|update\s+\w+\s+set|delete\s+from)\b")
    return n.filter(words & (((F.col("kind") == "string") & (F.col("name") == "+")) | ((F.col("kind") == "template") & F.col("value").contains("${"))))


def hooks_out_of_order(n: DataFrame) -> DataFrame:
    """Hooks that are called under a condition or in a loop."""
    return n.filter((F.col("kind") == "call") & F.col("name").rlike(r"^(?:React\.)?use[A-Z]\w*$") & (F.col("guarded") | F.col("looped")))


def expensive_state(n: DataFrame) -> DataFrame:
    """State whose first value is worked out by a call at every render: a call right behind useState( ."""
    after = n.select("file_id", (F.col("no") - 1).alias("no"), F.col("kind").alias("_k"), F.col("name").alias("_n"), F.col("line_no").alias("_l"))
    return n.filter("kind = 'call' and name in ('useState', 'React.useState')").join(after, ["file_id", "no"]).filter("_k = 'call' and _l = line_no and value = element_at(split(_n, '[.]'), 1)").drop("_k", "_n", "_l")


def hooks_misnamed(n: DataFrame) -> DataFrame:
    """Functions that call hooks and are named neither as a hook nor as a component."""
    callers = n.filter((F.col("kind") == "call") & F.col("name").rlike(r"^use[A-Z]")).select("file_id", F.col("scope").alias("no")).distinct()
    return n.filter((F.col("kind") == "function") & ~F.col("name").rlike(r"^(?:use[A-Z]|[A-Z])") & (F.col("value") != "method")).join(callers, ["file_id", "no"], "left_semi")


def listeners_kept(n: DataFrame) -> DataFrame:
    """Listeners and timers without their counterpart in the file: an anti-join on file and what they are."""
    pair = F.create_map(*[F.lit(x) for p in (("addEventListener", "removeEventListener"), ("setInterval", "clearInterval"), ("on", "off"), ("subscribe", "unsubscribe")) for x in p])
    last = F.element_at(F.split("name", r"\."), -1)
    calls = n.filter("kind = 'call'").withColumn("_last", last)
    opened = calls.withColumn("_pair", pair[F.col("_last")]).filter("_pair is not null")
    return opened.join(calls.select("file_id", F.col("_last").alias("_pair")).distinct(), ["file_id", "_pair"], "left_anti").drop("_pair", "_last")


def props_changed(n: DataFrame) -> DataFrame:
    """Assignments below props."""
    return n.filter((F.col("kind") == "assign") & F.col("name").rlike(r"^(?:this\.)?\$?props\."))


def redirects(n: DataFrame) -> DataFrame:
    """Addresses that are set from something that is no literal."""
    return n.filter((F.col("kind") == "assign") & F.col("name").rlike(r"^(?:window\.|document\.)?location(?:\.href)?$") & ~F.col("value").rlike("^[\"']") | (F.col("kind") == "call") & F.col("name").rlike(r"location\.(?:assign|replace)$|^window\.open$") & ~F.col("value").rlike("^[\"']"))


def code_from_text(n: DataFrame) -> DataFrame:
    """eval and its relatives; timers that are given a text."""
    return n.filter((F.col("kind") == "call") & (F.col("name").isin("eval", "Function", "window.eval") | F.col("name").isin("setTimeout", "setInterval") & F.col("value").rlike("^[\"']")))


#: rule id -> (severity, operator)
NODE_RULES = {
    "critical/xss/unsafe-html": (3, unsafe_html),
    "critical/csrf/missing-token": (2, forms_without_token),
    "critical/csrf/ajax-no-protection": (2, unprotected_requests),
    "critical/sql-injection/joined": (3, joined_sql),
    "security/script-injection": (3, code_from_text),
    "security/url/unsafe-redirect": (2, redirects),
    "react/hooks/out-of-order": (2, hooks_out_of_order),
    "react/hooks/expensive-init-state": (1, expensive_state),
    "react/hooks/invalid-hook-name": (1, hooks_misnamed),
    "vue/components/memory-leak": (2, listeners_kept),
    "vue/components/prop-mutation": (2, props_changed),
}


def match_rules(n: DataFrame) -> DataFrame:
    """(file_id, rule_id, severity, line_no, column_no) of all node rules; every rule reads ``n``, so it should be kept (``cut``)."""
    out = None
    for rule_id, (severity, operator) in NODE_RULES.items():
        found = _hit(rule_id, severity, operator(n))
        out = found if out is None else out.unionByName(found)
    return out
