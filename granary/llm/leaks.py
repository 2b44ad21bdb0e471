"""Evaluation passages in a corpus, by template canonicalisation.

Every word becomes itself or a typed placeholder: ``<number>`` (a word with a digit), ``<unit>`` (a unit of measure) or
``<name>`` (an identifier with an inner capital).  Digests of windows of ``window`` canonical words are joined between
items and documents, and the slots, the words behind the placeholders, are compared: all equal is a leak as it stands
(``leaked_items``), a consistent replacement is a re-parameterised item (``reworked_items``).

A word's type must not depend on how a document happens to write it, since case does not count.  So the items decide: a
word that an item has is a name if an item writes it with an inner capital; only words that no item has are typed by
their own form.

Scale: documents are read once and never shuffled as a whole.  A window is sent to the join only if its digest hits a
table of ``2 ** slot_bits`` bits made from the items; its size is fixed, so is that of the two word tables, and a hit
by chance costs a row in the join, never a result.  Items are few or many: the join is an ordinary one.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that measure a number.
UNITS = frozenset("ms s sec seconds minutes hours days times percent bytes kilobytes megabytes kb mb gb px renders copies characters fields rows sekunden minuten stunden tage prozent kopien bytes zeilen zeichen".split())

_WORD = re.compile(r"[^\W_]+")
_INNER = re.compile(r"[a-z0-9][A-Z]")
_DIGIT = re.compile(r"\d")
#: what is markup and yet would count as words: tags, character references, numbers of list items
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|&#?\w+;|^[ \t]*(?:[>|*+#-][ \t]*)*\(?(?:\d{1,4}|[A-Za-z])[.):](?=[ \t])", re.M | re.S)
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_BASE = 0x9E3779B97F4A7C15 | 1
_NUMBER, _NAME, _UNIT = 3, 5, 7


def readings(text: str) -> list[list[str]]:
    """The words of a text, and, where it has markup that looks like words, its words without that markup."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    plain = _WORD.findall(text)
    if not _MARKUP.search(text):
        return [plain]
    # a reference or tag within a word joins its halves only if it is an inline one
    bare = _WORD.findall(_MARKUP.sub(lambda m: html.unescape(m[0]) if m[0][0] == "&" else " ", text))
    return [plain] if bare == plain else [plain, bare]


class Canon:
    """Words to codes; ``known`` and ``names`` are bit tables over word digests (items' words, items' names)."""

    def __init__(self, known: np.ndarray, names: np.ndarray):
        self.known, self.names, self.codes = known, names, {}

    def code(self, word: str) -> int:
        got = self.codes.get(word)
        if got is None:
            low = word.lower()
            digest = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"))
            slot = digest % len(self.known)
            if low in UNITS:
                got = _UNIT
            elif _DIGIT.search(low):
                got = _NUMBER
            elif self.names[slot] if self.known[slot] else bool(_INNER.search(word)):
                got = _NAME
            else:
                got = digest | 8
            if len(self.codes) > 1_000_000:  # bounds the memory of a worker; a cleared cache fills again
                self.codes.clear()
            self.codes[word] = got
        return got

    def windows(self, words: list[str], window: int) -> np.ndarray:
        """Digest of every window of canonical words."""
        n = len(words) - window + 1
        if n < 1:
            return np.empty(0, np.int64)
        codes = np.fromiter(map(self.code, words), np.uint64, len(words))
        total = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(window):
                total = total * np.uint64(_BASE) + codes[k : k + n]
            total ^= total >> np.uint64(31)
            total *= np.uint64(0xBF58476D1CE4E5B9)
            total ^= total >> np.uint64(29)
        return total.view(np.int64)


def _slots(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bit table of a column of digests: at most ``2 ** bits`` distinct slots reach the driver."""
    table = np.zeros(1 << bits, bool)
    rows = df.select(F.pmod(F.col(column), F.lit(1 << bits)).cast("int").alias("slot")).distinct().toPandas()
    table[rows["slot"].to_numpy(np.int64)] = True
    return table


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = {w for text in pdf["text"] for words in readings(text) for w in words}
        digest = [xxhash.xxh64_intdigest(w.lower().encode("utf-8", "surrogatepass")) for w in found]
        yield pd.DataFrame({"digest": np.array(digest, np.uint64).view(np.int64), "name": [bool(_INNER.search(w)) for w in found]})


def _windows_of(known: np.ndarray, names: np.ndarray, window: int, hits: np.ndarray | None):
    """Rows (id, digest, place, reading, words) of every window, or of those whose digest's slot is in ``hits``."""
    known, names = np.packbits(known), np.packbits(names)
    hits = None if hits is None else np.packbits(hits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = Canon(np.unpackbits(known).astype(bool), np.unpackbits(names).astype(bool))
        table = None if hits is None else np.unpackbits(hits).astype(bool)
        for pdf in batches:
            rows: list[tuple] = []
            for i, text in zip(pdf["id"].tolist(), pdf["text"].tolist(), strict=True):
                for no, words in enumerate(readings(text)):
                    digests = canon.windows(words, window)
                    at = np.arange(len(digests)) if table is None else np.flatnonzero(table[digests & (len(table) - 1)])
                    for k in at.tolist():
                        rows.append((i, int(digests[k]), k, no, " ".join(words[k : k + window]).lower()))
            yield pd.DataFrame(rows, columns=["id", "digest", "place", "reading", "words"])

    return run


def template_matches(docs: DataFrame, items: DataFrame, *, window: int = 15, slot_bits: int = 22) -> DataFrame:
    """(item_id, doc_id, item_place, doc_place, reading, item_words, doc_words): windows of equal templates.

    docs has doc_id and text, items has item_id and text; rows with a null in these are left out, repeated rows count
    once, texts of fewer than ``window`` words have no window, other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").alias("id"), "text").filter("id is not null and text is not null")
    items = items.select(F.col("item_id").alias("id"), "text").filter("id is not null and text is not null").distinct()
    words = items.select("text").mapInPandas(_item_words, "digest bigint, name boolean")
    known, names = _slots(words, "digest", slot_bits), _slots(words.filter("name"), "digest", slot_bits)
    schema = "id bigint, digest bigint, place int, reading int, words string"
    theirs = items.mapInPandas(_windows_of(known, names, window, None), schema)
    ours = docs.mapInPandas(_windows_of(known, names, window, _slots(theirs, "digest", slot_bits)), schema)
    theirs = theirs.select(F.col("id").alias("item_id"), "digest", F.col("place").alias("item_place"), F.col("words").alias("item_words")).distinct()
    ours = ours.select(F.col("id").alias("doc_id"), "digest", F.col("place").alias("doc_place"), "reading", F.col("words").alias("doc_words"))
    return ours.join(theirs, "digest").drop("digest")


def leaked_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(item_id, doc_id), distinct: documents with ``window`` successive words of an item, every slot equal."""
    return template_matches(docs, items, **options).filter("item_words = doc_words").select("item_id", "doc_id").distinct()


def reworked_items(docs: DataFrame, items: DataFrame, *, min_windows: int = 5, **options) -> DataFrame:
    """(item_id, doc_id, windows, replaced): items that a document holds with other numbers, names or units.

    Windows of one alignment (same distance between the places) are taken together.  The replacement is consistent if no
    slot word of the item stands for two words in the document; at least ``min_windows`` windows and one replaced word.
    """
    matches = template_matches(docs, items, **options).withColumn("shift", F.col("doc_place") - F.col("item_place"))
    key = ["item_id", "doc_id", "reading", "shift"]
    sizes = matches.groupBy(*key).agg(F.countDistinct("item_place").alias("windows"))
    slots = matches.select(*key, F.explode(F.arrays_zip(F.split("item_words", " ").alias("a"), F.split("doc_words", " ").alias("b"))).alias("s")).select(*key, "s.a", "s.b").distinct()
    slots = slots.groupBy(*key).agg(F.countDistinct("a").alias("_a"), F.count("*").alias("_ab"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("replaced"))
    good = sizes.join(slots, key).filter(f"_a = _ab and replaced > 0 and windows >= {min_windows}")
    return good.groupBy("item_id", "doc_id").agg(F.max("windows").alias("windows"), F.min("replaced").alias("replaced"))
