"""Scalar functions on Columns: text, paths, hashes, versions and edits by place. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(text: Column, length: int) -> Column:
    """The text if it is short enough, else its beginning and three dots; null stays null."""
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.substring(text, 1, length), F.lit("...")))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def format_bytes(size: Column, digits: int = 2) -> Column:
    """1536 -> ``1.5 KB``: powers of 1024, rounded, without zeros at the end; null and nothing are ``0 Bytes``."""
    power = F.least(F.lit(4), F.floor(F.log2(size.cast("double")) / 10 + 1e-12)).cast("int")
    number = F.round(size / F.pow(F.lit(1024.0), power), digits)
    plain = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", number), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    unit = F.get(F.array(*[F.lit(u) for u in ("Bytes", "KB", "MB", "GB", "TB")]), power)
    return F.when(size.isNull() | (size <= 0), F.lit("0 Bytes")).otherwise(F.concat_ws(" ", plain, unit))


def text_hash(text: Column) -> Column:
    """The 31-multiplier hash over code units in 32 bits, made positive (characters above the basic plane count as one)."""
    codes = F.transform(F.split(text, ""), F.ascii)
    folded = F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, c: F.pmod(acc * 31 + c, F.lit(1 << 32)))
    signed = F.when(folded >= 1 << 31, folded - (1 << 32)).otherwise(folded)
    return F.abs(signed)


def glob_regex(pattern: str) -> str:
    """A path pattern as an anchored regular expression: dots are dots, stars are anything."""
    return "^" + pattern.replace(".", "\\.").replace("*", ".*") + "$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """True where a pattern with a star matches the whole path, or one without stands somewhere in it."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    hit = F.lit(False)
    for p in patterns:
        hit = hit | (path.rlike(glob_regex(p)) if "*" in p else path.contains(p))
    return hit


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    """What stands before the last slash; ``.`` without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def relative(path: Column, root: Column) -> Column:
    """The path below a root, or the path itself if it isn't below."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(path.startswith(base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)


def next_version(version: Column, major: bool = False) -> Column:
    """The version after a.b.c; what is no such version becomes 1.0.0."""
    part = lambda n: F.regexp_extract(version, r"^(\d+)\.(\d+)\.(\d+)$", n).cast("bigint")
    new = F.concat(part(1) + 1, F.lit(".0.0")) if major else F.concat(part(1), F.lit("."), part(2) + 1, F.lit(".0"))
    return F.when(version.rlike(r"^\d+\.\d+\.\d+$"), new).otherwise(F.lit("1.0.0"))


def position(text: Column, word: str) -> Column:
    """1-based offset of the first occurrence, 0 if there is none."""
    return F.instr(text, word)


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a 1-based offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset - 1), "\n"))


def column_at(text: Column, offset: Column) -> Column:
    """1-based column of a 1-based offset."""
    return F.length(F.element_at(F.split(F.substring(text, F.lit(1), offset - 1), "\n"), -1)) + 1


def offset_at(text: Column, line: Column, column: Column) -> Column:
    """1-based offset of a 1-based line and column: the lines before, each with its end."""
    before = F.slice(F.split(text, "\n"), F.lit(1), F.greatest(line - 1, F.lit(0)))
    return F.aggregate(before, F.lit(0), lambda acc, x: acc + F.length(x) + 1) + column


def snippet(text: Column, offset: Column, length: Column, around: int = 20) -> Column:
    """Text around a place, trimmed."""
    start = F.greatest(offset - around, F.lit(1))
    return F.trim(F.regexp_replace(F.substring(text, start, offset + length + around - start), r"^\s+|\s+$", ""))


def replaced_range(text: Column, start: Column, end: Column, by: Column) -> Column:
    """Text with the 1-based offsets start..end (end not included) replaced; equal offsets insert, an empty text deletes."""
    return F.concat(F.substring(text, F.lit(1), start - 1), by, F.substring(text, end, F.length(text)))


def fill_template(template: Column, values: Column) -> Column:
    """``{name}`` replaced by values (a map); unknown names are left as they are."""
    return F.aggregate(F.map_entries(values), template, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def merged(base: Column, over: Column) -> Column:
    """Two maps as one; the second wins."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)
