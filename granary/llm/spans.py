"""Exact spans of at least ``min_chars`` characters shared between texts.

Two operators:

* ``unit_duplicates``: line or paragraph hashing.  Units are normalised and hashed, digests grouped globally, the
  earliest occurrence (lowest id, then lowest offset) is kept and every other one reported with its original offsets.
* ``shared_spans``: all pairs of texts that share a stretch of ``min_chars`` characters, exactly.  A stretch may begin
  and end inside a line and hold no line end at all, so whole lines alone lose pairs.  The unit here is therefore a
  window of ``unit`` characters chosen by its content: of all windows that begin within ``min_chars - unit + 1``
  successive characters the one with the least digest.  Any shared stretch of ``min_chars`` holds such a choice
  entirely, so every pair meets in at least one digest; the characters around it are then compared exactly.

Scale: the digests are the only thing shuffled for all texts (about one per hundred characters).  Copies of a text are
one text until the very end.  Only texts with a digest in common with another text send their contexts, which have at
most ``2 * min_chars`` characters.  A digest of many texts is a join key of that many rows, which adaptive execution
splits; nothing is collected into one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _opening(h: np.ndarray, width: int) -> np.ndarray:
    """True where h is the least value of some window of ``width`` successive entries (all such, if there are ties)."""

    def slide(x: np.ndarray, pick) -> np.ndarray:
        span = 1
        while span < width:
            step = min(span, width - span)
            x = pick(x[: len(x) - step], x[step:])
            span += step
        return x

    least = slide(h, np.minimum)  # of the windows that begin at i
    pad = np.zeros(width - 1, h.dtype)
    return slide(np.concatenate([pad, least, pad]), np.maximum) == h


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads polynomial sums over all 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chosen_windows(text: str, min_chars: int, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, digests) of the windows of ``unit`` characters that stand for ``text``; none if it is too short."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < min_chars:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        up = np.full(len(codes), _BASE)
        up[0] = 1
        up = np.cumprod(up, dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
        n = len(codes) - unit + 1
        down = np.full(n, _INV)
        down[0] = 1
        down = np.cumprod(down, dtype=np.uint64)
        h = _mix((total[unit:] - total[:n]) * down)
    at = np.flatnonzero(_opening(h, min_chars - unit + 1))
    return at, h[at].view(np.int64)


def _windows(min_chars: int, unit: int):
    schema = pa.schema([("_text", pa.int64()), ("_at", pa.int32()), ("_digest", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ats, digests = [], [], []
            for i, text in zip(batch.column("_text").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at, digest = chosen_windows(text, min_chars, unit)
                ids.append(np.full(len(at), i, np.int64))
                ats.append(at)
                digests.append(digest)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(ats).astype(np.int32)), pa.array(np.concatenate(digests))], schema=schema)

    return run


def _common(a: str, b: str, limit: int) -> F.Column:
    """Length of the common beginning of two columns, up to ``limit``, as a binary search that runs in the JVM."""
    steps = F.array(*[F.lit(1 << k) for k in range(limit.bit_length() - 1, -1, -1)])
    same = lambda n: F.substring(F.col(a), F.lit(1), n) == F.substring(F.col(b), F.lit(1), n)
    fits = lambda n: (F.length(a) >= n) & (F.length(b) >= n)
    return F.aggregate(steps, F.lit(0), lambda acc, x: F.when(fits(acc + x) & same(acc + x), acc + x).otherwise(acc))


def shared_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 500, unit: int = 300) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all pairs of rows whose texts have ``min_chars`` successive characters in common.

    Characters are code points and compared as they are.  Rows with a null id or text and texts shorter than
    ``min_chars`` are in no pair; rows of one id with different texts count as that id's texts, never as a pair of their
    own.  Repeated rows count once, an empty table gives an empty result, other columns are ignored.
    """
    if not 0 < unit <= min_chars:
        raise ValueError("unit must be between 1 and min_chars")
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter(f"_id is not null and length(text) >= {min_chars}")
    docs = docs.withColumn("_text", F.xxhash64("text", F.lit(0)))
    copies = docs.select("_text", "_id").distinct()
    places = docs.select("_text", "text").mapInArrow(_windows(min_chars, unit), "_text bigint, _at int, _digest bigint")
    # copies of a text repeat its places: one row each
    places = places.groupBy("_digest", "_text", "_at").agg(F.lit(1).alias("_one")).drop("_one")
    met = places.groupBy("_digest").agg(F.min("_text").alias("_lo"), F.max("_text").alias("_hi")).filter("_lo < _hi").select("_digest")
    places = places.join(met, "_digest", "left_semi")
    texts = docs.groupBy("_text").agg(F.min("_id").alias("_id"))  # the row that gives a text its characters
    places = places.join(texts, "_text")
    extra = min_chars - unit
    # the digest's places with what stands before (read backwards) and after them
    near = places.join(docs.select("_id", "_text", "text"), ["_id", "_text"])
    before = F.reverse(F.substring("text", F.greatest(F.lit(1), F.col("_at") + 1 - extra), F.least(F.col("_at"), F.lit(extra))))
    near = near.select("_digest", "_text", F.substring("text", F.col("_at") + 1, F.lit(unit)).alias("unit"), before.alias("before"), F.substring("text", F.col("_at") + 1 + unit, F.lit(extra)).alias("after")).distinct()
    a = near.select("_digest", F.col("_text").alias("ta"), F.col("unit").alias("ua"), F.col("before").alias("ba"), F.col("after").alias("aa"))
    b = near.select("_digest", F.col("_text").alias("tb"), F.col("unit").alias("ub"), F.col("before").alias("bb"), F.col("after").alias("ab"))
    pairs = a.join(b, (a["_digest"] == b["_digest"]) & (F.col("ta") < F.col("tb")))
    if extra:
        pairs = pairs.filter((F.col("ua") == F.col("ub")) & (_common("aa", "ab", extra) + _common("ba", "bb", extra) >= extra))
    else:
        pairs = pairs.filter("ua = ub")
    pairs = pairs.select("ta", "tb").distinct()
    left, right = copies.select(F.col("_text").alias("ta"), F.col("_id").alias("a")), copies.select(F.col("_text").alias("tb"), F.col("_id").alias("b"))
    across = pairs.join(left, "ta").join(right, "tb").select("a", "b")
    same = left.join(right, (F.col("ta") == F.col("tb")) & (F.col("a") < F.col("b"))).select("a", "b")
    return across.union(same).filter("a <> b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()


def unit_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_unit: int = 40) -> DataFrame:
    """Lines that stand in an earlier place too: (doc_id, start, length, first_doc, first_start), offsets as in the original.

    A line is normalised (trimmed, white space runs as one space) before it is hashed; lines of fewer than ``min_unit``
    normalised characters are too common to tell anything and are left alone.  The earliest place of a line, by id and
    offset, is kept; every other one is a row.  Null ids and texts have no lines; repeated rows count once.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null").filter(F.length("text") >= min_unit)
    lines = docs.select("doc_id", F.split("text", "\n").alias("_lines"))
    # offset of every line: the lengths before it and one line end each
    offsets = F.expr("aggregate(_lines, array(0), (acc, x) -> concat(acc, array(element_at(acc, -1) + length(x) + 1)))")
    lines = lines.filter(F.exists("_lines", lambda x: F.length(x) >= min_unit))
    units = lines.select("doc_id", F.posexplode("_lines").alias("_no", "line"), offsets.alias("_offsets")).filter(F.length("line") >= min_unit)
    plain = F.trim(F.regexp_replace("line", r"\s+", " "))
    units = units.select("doc_id", F.element_at("_offsets", F.col("_no") + 1).alias("start"), F.length("line").alias("length"), plain.alias("plain")).filter(F.length("plain") >= min_unit)
    units = units.select("doc_id", "start", "length", F.xxhash64("plain").alias("_h1"), F.hash("plain").alias("_h2")).distinct()
    first = units.groupBy("_h1", "_h2").agg(F.min(F.struct("doc_id", "start")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    later = units.join(first, ["_h1", "_h2"]).filter("struct(doc_id, start) > _first")
    return later.select("doc_id", "start", "length", F.col("_first.doc_id").alias("first_doc"), F.col("_first.start").alias("first_start"))


def shared_share(docs: DataFrame, **options) -> DataFrame:
    """Per doc_id: characters of the text, characters in lines that stand earlier too, and their share."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    removed = unit_duplicates(docs, **options).groupBy("doc_id").agg(F.sum("length").alias("shared_chars"), F.count("*").alias("shared_lines"))
    sizes = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.length(text_col)).alias("chars"))
    return sizes.join(removed, "doc_id").withColumn("share", F.round(F.col("shared_chars") / F.col("chars"), 6))
