"""Credentials in source code and configuration: find the lines, hide the values, leave the code as it is.

The text is cut into tokens (comments, strings, templates, regular expressions, words, marks).  A literal is a
credential if its value is not a placeholder and it is assigned or passed to something named for a credential, or if it
has a form that only credentials have (issued tokens, private keys, user and password in an address, signed addresses,
authorization headers).  Pieces joined by ``+`` are one literal, encoded literals stand for what they hold, and comments
and dotenv lines have their own readings.  Hiding replaces the characters of the value only, one for one: quotation
marks, escapes, substitutions, line ends and all offsets stay.

Scale: no shuffle at all.  A row reaches Python only if its text has a word or form that every rule needs
(``HINTS``, tested in the JVM); the rest can't hold a finding.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the last word of a credential's name is.
_NOUNS = frozenset("password passwd passwords pwd pw pass passwort passphrase contrasena contraseña kennwort secret secrets token tokens apikey cred creds credential credentials authtoken accesstoken 密码".split())
# What comes before "key" if the key opens something.
_KEY_KINDS = frozenset("api access deploy private secret signing auth encryption service master account admin license client x hook webhook session".split())
# Functions that are given credentials.
_TAKERS = frozenset("login signin authenticate logon".split())
# What people write where a credential will stand.
_PLACEHOLDER = re.compile(
    r"^(?:<.*>|\{\{.*\}\}|\$\{?[\w.]+\}?|%\w+%|\[.*\]|[*xX.•_-]+|todo|fixme|tbd|none|null|undefined|true|false|replace[-_ ]?me|change[-_ ]?(?:me|it)|placeholder|dummy|redacted|your[-_ ].*|enter[-_ ].*|insert[-_ ].*|my[-_](?:password|secret|token)|example.*|sample.*|.*example|base64(?:url)?|utf-?8|utf-?16le|latin1|sha-?\d+|md5|[hre]s\d{3}|oauth2?|pbkdf2)$",
    re.I,
)
# Forms of issued tokens.
_ISSUED = (
    r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|rk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{20,}|npm_[A-Za-z0-9]{30,}"
    r"|AIza[\w-]{33,39}|eyJ[\w-]{8,}={0,2}\.[\w-]{8,}={0,2}\.[\w-]{16,}|glpat-[\w-]{18,}|[a-z]{3,8}_(?:svc|pat|prod|live|key)_[A-Za-z0-9]{20,}"
)
_TOKEN = re.compile(rf"(?<![\w/+-])(?:{_ISSUED})(?![\w/+])")
_IN_ADDRESS = re.compile(r"\b[a-z][a-z0-9+.-]*://[^\s:/@'\"`$<{*]+:([^\s@/'\"`$<{*]{3,})@")
_SIGNED = re.compile(r"[?&](?:sig|signature|key|api_?key|access_token|auth_token|token|secret|password|pwd)=([\w%.~-]{12,})", re.I)
_HEADER = re.compile(r"\b(?:Bearer|Basic|Token) +([\w.~+/-]{8,}=*)")
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----((?:\\[nr]|[^-])*)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)?")
_SAID = re.compile(
    r"(?:\b(?:password|passwort|passwd|pwd|passphrase|secret|token|api[ _-]?key|kennwort|contraseña|contrasena|mot de passe|credentials?|login)\b|密码|口令)"
    r"(?:\s+(?:for|of|to|on|used|für|de|para|old|new|the|\w+)){0,4}?\s*(?:[:=：]|\bis\b|\bwas\b|\bwar\b|\bist\b|\bes\b|\bera\b)\s*(?:[\w.-]+\s*/\s*)?[\"'`]?([^\s\"'`<>,;]{6,})",
    re.I,
)
_CURL = re.compile(r"\bcurl\b.*?\s-u\s*[\"']?[^\s:\"'$]+:([^\s\"'$<{]{4,})")
_ENV = re.compile(r"^[ \t]*(?:#[ \t]*)?(?:export[ \t]+)?([A-Za-z_][A-Za-z0-9_.]*)[ \t]*=[ \t]*(\"(?:\\.|[^\"\\\n])*\"|'[^'\n]*'|[^\s#][^\n]*?)[ \t\r]*$", re.M)

_LEX = re.compile(
    r"""(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|$)|<!--[\s\S]*?(?:-->|$))
    |(?P<string>"(?:\\[\s\S]|[^"\\\n])*"?|'(?:\\[\s\S]|[^'\\\n])*'?)
    |(?P<template>`(?:\\[\s\S]|[^`\\])*`?)
    |(?P<regex>(?:(?<=[=(,:\[!&|?;{}])|(?<=[=(,:\[!&|?;{}][ ]))/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*)
    |(?P<word>[^\W\d][\w$]*|\$[\w$]*)
    |(?P<mark>\n|=>|===?|!==?|<=|>=|[^\s\w])
    |(?P<number>\d[\w.]*)""",
    re.X,
)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
_BASE64 = re.compile(r"^[A-Za-z0-9+/]{8,}={0,2}$")

#: Every finding needs one of these in the lower-cased text, or an address with a user; other rows are never looked at.
HINTS = (
    *"pass pwd _pw pw= pw: pw' secret token cred contrase kennwort 密码 口令 login logon signin authenticat key curl sig= signature= bearer basic akia ghp_ gho_ ghu_ ghs_ ghr_ github_pat_".split(),
    *"sk_live sk_test rk_live xoxa- xoxb- xoxp- xoxr- xoxs- npm_ aiza eyj glpat- _svc_ _pat_ _prod_ _live_".split(),
    'pw"',
    "pw =",
    "mot de passe",
)
_USER = r"://[^\s/]*@"


def hinted(text: Column) -> Column:
    """A text can hold a credential: one pass of plain searches in the JVM."""
    low = F.lower(text)
    out = F.lit(False)
    for word in HINTS:
        out = out | low.contains(word)
    return out | (text.contains("://") & text.rlike(_USER))


def has_hint(text: str) -> bool:
    low = text.lower()
    return any(word in low for word in HINTS) or re.search(_USER, text) is not None


class Finding(NamedTuple):
    """A credential: line of its beginning, kind, and the stretches of text that hold it."""

    line: int
    kind: str
    spans: tuple[tuple[int, int], ...]


def named_for(name: str) -> str:
    """``sure`` if a name is a credential's, ``maybe`` for a key of unknown use, else nothing."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts:
        return ""
    last = parts[-1]
    if last in _NOUNS or "".join(parts[-2:]) in ("apikey", "passwort"):
        return "" if parts[0] in ("public", "next", "csrf") and last not in ("password", "secret") else "sure"
    if last == "key":
        if name[-1].isdigit():
            return "sure"
        return "sure" if len(parts) > 1 and parts[-2] in _KEY_KINDS else "" if len(parts) > 1 else "maybe"
    return ""


def opens(value: str, kind: str = "sure") -> bool:
    """A value that can open something: no placeholder, no words, no reference."""
    if len(value) < 6 or any(c.isspace() for c in value) or _PLACEHOLDER.match(value) or "${" in value or "{{" in value or value.startswith(("process.", "import.", "http://localhost")):
        return False
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    mixed = any(c.isupper() for c in value) and any(c.islower() for c in value)
    if kind == "maybe":
        return len(value) >= 16 and digits >= 2 and letters >= 4
    if re.match(r"^(?:\.{0,2}/|https?://|@[\w-]+/)", value) or not letters and len(value) < 8:
        return False
    return digits > 0 or mixed and len(value) >= 10 and bool(not value.isalpha() or re.search("[A-Z]{2}", value))


def held(value: str) -> bool:
    """What stands where only a password can stand: anything but a placeholder."""
    return len(value) >= 4 and not _PLACEHOLDER.match(value) and not re.match(r"^(?:pass(?:word)?|pwd|secret|token|user(?:name)?)$", value, re.I)


def _inside(text: str, start: int, end: int) -> tuple[int, int]:
    """A literal without its quotation marks."""
    return start + 1, end - 1 if end - start > 1 and text[end - 1] == text[start] else end


def _forms(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Stretches of a piece of text that are credentials by their form."""
    piece = text[start:end]
    for kind, pattern in (("issued", _TOKEN), ("address", _IN_ADDRESS), ("signed", _SIGNED), ("header", _HEADER)):
        for m in pattern.finditer(piece):
            at, to = m.span(1) if pattern.groups else m.span()
            if kind == "issued" or held(piece[at:to]) and (kind != "header" or len(piece[at:to]) >= 12):
                yield kind, start + at, start + to


def find(text: str, path: str = "") -> list[Finding]:
    """All credentials of a text; of several on a line or within each other every one, in the order of their beginnings."""
    found: dict[int, Finding] = {}
    breaks: list[int] = []

    def line(at: int) -> int:
        if not breaks:
            breaks.extend(m.start() for m in re.finditer("\n", text))
            breaks.append(len(text))
        return bisect.bisect_left(breaks, at) + 1

    begins: list[int] = []

    def add(kind: str, spans: list[tuple[int, int]]) -> None:
        start = spans[0][0]
        k = bisect.bisect_right(begins, start)
        if k and start < found[begins[k - 1]].spans[-1][1]:
            return  # within one that is found already
        begins.insert(k, start)
        found[start] = Finding(line(start), kind, tuple(spans))

    for m in _KEY_BLOCK.finditer(text) if "PRIVATE KEY" in text else ():
        body = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", m[1])
        if len(body) >= 40 and len(set(body)) > 4:
            found[m.start()] = Finding(line(m.start()), "private key", (m.span(1),))
            begins.append(m.start())
    if ".env" in path.rpartition("/")[2]:
        _in_env(text, add)
    _in_code(text, add)  # of dotenv files too: an issue's code may be a line of its own
    return sorted(found.values())


def _in_env(text: str, add) -> None:
    for m in _ENV.finditer(text):
        start, end = m.span(2)
        if text[start] in "\"'":
            start, end = _inside(text, start, end)
        if named_for(m[1]) == "sure" and opens(text[start:end]):
            add("named", [(start, end)])
        else:
            for kind, at, to in _forms(text, start, end):
                add(kind, [(at, to)])
    at = 0
    for raw in text.split("\n"):
        if raw.lstrip().startswith("#") and not _ENV.match(raw):
            _in_comment(text, at, at + len(raw), add)
        at += len(raw) + 1


def _in_comment(text: str, start: int, end: int, add) -> None:
    for kind, at, to in _forms(text, start, end):
        add(kind, [(at, to)])
    for m in _CURL.finditer(text, start, end):
        if held(m[1]):
            add("comment", [m.span(1)])
    for m in _SAID.finditer(text, start, end):
        at, to = m.span(1)
        while to > at and text[to - 1] in ")]}":
            to -= 1
        value = text[at:to]
        if opens(value) and any(c.isdigit() for c in value) and not re.match(r"^[\w.-]+\(|^\d+$", value):
            add("comment", [(at, to)])
    # code that was commented out
    piece = text[start:end]
    for m in _ENV.finditer(piece.lstrip("/*# ")):
        shift = start + len(piece) - len(piece.lstrip("/*# "))
        at, to = shift + m.start(2), shift + m.end(2)
        if text[at] in "\"'":
            at, to = _inside(text, at, to)
        if named_for(m[1]) == "sure" and opens(text[at:to]):
            add("comment", [(at, to)])


def _in_code(text: str, add, begin: int = 0, stop: int | None = None) -> None:
    stop = len(text) if stop is None else stop
    tokens = [(m.lastgroup, m.start(), m.end()) for m in _LEX.finditer(text, begin, stop)]
    n = len(tokens)
    for i, (kind, start, end) in enumerate(tokens):
        # where a quotation or comment is never closed it swallows code, and code and quotations change places behind it
        if (kind == "template" or kind == "comment" and text[start] != "/" or kind == "comment" and text[start : start + 2] == "/*" and not text.endswith("*/", start, end)) and "\n" in text[start:end]:
            at = start + 1
            while at < end:
                to = text.find("\n", at, end)
                to = end if to < 0 else to
                _in_code(text, add, at, to)
                at = to + 1
        if kind == "comment":
            _in_comment(text, start, end, add)
        elif kind in ("string", "template"):
            for form, at, to in _forms(text, *_inside(text, start, end)):
                add(form, [(at, to)])
            if i + 1 < n and text[tokens[i + 1][1]] == ":":
                _given(text, tokens, i + 1, named_for(text[start + 1 : end - 1]), add)
            elif i + 2 < n and text[tokens[i + 1][1]] == "," and tokens[i + 2][0] in ("string", "template") and named_for(text[start + 1 : end - 1]):
                at, to = _inside(text, *tokens[i + 2][1:])
                if opens(text[at:to], named_for(text[start + 1 : end - 1])):
                    add("passed", [(at, to)])
        elif kind == "word" and i + 1 < n:
            word, mark = text[start:end], text[tokens[i + 1][1] : tokens[i + 1][2]]
            if mark in (":", "="):
                _given(text, tokens, i + 1, named_for(word), add)
            elif mark == "(" and word.lower() in _TAKERS:
                depth, k = 0, i + 1
                while k < n and k < i + 60:
                    mark = text[tokens[k][1] : tokens[k][2]]
                    depth += (mark in "([{") - (mark in ")]}") if tokens[k][0] == "mark" else 0
                    if depth == 0:
                        break
                    if tokens[k][0] in ("string", "template"):
                        at, to = _inside(text, *tokens[k][1:])
                        if opens(text[at:to]) and not re.match(r"^[\w.+-]+@", text[at:to]):
                            add("passed", [(at, to)])
                    k += 1


def _given(text: str, tokens: list, i: int, kind: str, add) -> None:
    """The literals of the expression behind the mark at i: pieces joined by + are one value, alternatives stand alone."""
    if not kind:
        return
    k, depth, joined = i + 1, 0, []
    groups: list[list[tuple[int, int]]] = []
    typed = text[tokens[i][1]] == ":"
    while k < len(tokens):
        sort, start, end = tokens[k]
        mark = text[start:end]
        if sort in ("string", "template"):
            joined.append(_inside(text, start, end))
        elif sort == "mark":
            if mark == "\n":
                before = tokens[k - 1]
                ahead = text[tokens[k + 1][1]] if k + 1 < len(tokens) else ""
                if depth == 0 and text[before[1] : before[2]] not in ("+", "=", ":", "|", "?") and ahead not in ("+", "|", "?", "."):
                    break
            elif mark in "([{":
                depth += 1
                if mark == "{":
                    break
            elif mark in ")]}":
                depth -= 1
                if depth < 0:
                    break
            elif mark == ";" or mark == "," and depth == 0 or mark == "=>":
                break
            elif mark == "=" and typed:
                typed = False
            elif mark != "+" and joined:
                groups.append(joined)
                joined = []
        elif sort == "word" and joined:
            groups.append(joined)
            joined = []
        k += 1
    if joined:
        groups.append(joined)
    for spans in groups:
        value = "".join(text[a:b] for a, b in spans)
        if "${" not in value and opens(value, kind) and not value.startswith("-----BEGIN"):
            add("named", spans)


_KEEP = re.compile(r"\\(?:u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|\r?\n|.)|\$\{[^}]*\}|\s", re.S)


def hide(text: str, path: str = "", mark: str = "x") -> str:
    """The text with every credential's characters replaced by ``mark``; escapes, substitutions and white space stay."""
    out, last = [], 0
    for start, end in sorted(span for f in find(text, path) for span in f.spans):
        if start < last:
            continue
        out.append(text[last:start])
        at = start
        for m in _KEEP.finditer(text, start, end):
            out += [mark * (m.start() - at), m[0]]
            at = m.end()
        out.append(mark * (end - at))
        last = end
    return "".join([*out, text[last:]])


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, f.line, f.kind) for i, path, text in zip(pdf["row_id"].tolist(), pdf["path"].tolist(), pdf["text"].tolist(), strict=True) for f in find(text, path or "")]
        yield pd.DataFrame(rows, columns=["row_id", "line_no", "kind"])


def credential_lines(table: DataFrame, row_id: str | Column, text: str | Column, path: str | Column) -> DataFrame:
    """(row_id, line_no, kind): the lines, cut at LF and counted from 1, on which a credential begins.

    Rows with a null id or text have none; a null path is code; repeated rows give repeated lines; an empty table gives
    an empty result, other columns are ignored.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = table.select(col(row_id).cast("bigint").alias("row_id"), col(text).alias("text"), col(path).alias("path"))
    rows = rows.filter("row_id is not null and text is not null").filter(hinted(F.col("text")))
    return rows.mapInPandas(_lines, "row_id bigint, line_no int, kind string")


def redacted(table: DataFrame, text: str, path: str) -> DataFrame:
    """The table with the credentials in column ``text`` hidden; all rows and columns are kept, nulls too."""

    @F.pandas_udf("string")
    def hidden(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else hide(t, p or "") for t, p in zip(texts, paths, strict=True)], dtype=object)

    return table.withColumn(text, F.when(hinted(F.col(text)), hidden(F.col(text), F.col(path))).otherwise(F.col(text)))
