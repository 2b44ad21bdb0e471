"""New batches of reports against all reports accepted before.

Reports are compared within a cell: the names (component, function, API) that the description mentions, lower-cased.
In a cell the accepted texts form immutable segments, one suffix array over the concatenated words of each batch.  A new
text looks its word runs up in every segment by binary search, the runs found are added up to a coverage for each
accepted record, and a record with enough of it is compared word for word.  Texts that no record repeats are accepted,
become the batch's own segment, and segments of similar size are merged, so that there are logarithmically many.

Scale: numbers, dates, ids, case, spacing and punctuation are taken out first and reports that are equal then are one
row, whatever their number; cells of one row need no comparison and never leave the JVM.  The rest is sorted by cell and
streamed: a task holds the accepted texts of one cell, not its reports.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.lineage import cut

#: APIs of the page that have no inner capital, so that only a list tells them from words.
PLAIN_APIS = ("eval", "fetch", "Function", "document.write", "location.assign", "window.open")

#: What may stand before a path's own part.
ROOTS = r"^(?:webpack:/+|file:/+|[a-z]:/(?:agent/ws/)?|/home/[^/]+/work/|/builds?/|/workspace/|/app/|\./|/)+"


class Segment:
    """Suffix array over the words of some records; never changed once it is built."""

    def __init__(self, records: list[tuple[int, list[str]]]):
        self.records = records
        self.words: list[str] = []
        self.owner: list[int] = []
        for no, (_, words) in enumerate(records):
            self.words += [*words, "\0"]  # no run goes on into the next record
            self.owner += [no] * (len(words) + 1)
        self.order = sorted((p for p, w in enumerate(self.words) if w != "\0"), key=lambda p: self.words[p : p + 64])

    def run(self, words: list[str]) -> set[int]:
        """Records that hold these words in a row."""
        n = len(words)
        key = lambda p: self.words[p : p + n]
        return {self.owner[p] for p in self.order[bisect.bisect_left(self.order, words, key=key) : bisect.bisect_right(self.order, words, key=key)]}

    def coverage(self, words: list[str], run: int) -> dict[int, int]:
        """Per record: how many of ``words`` lie in runs of ``run`` words that it holds too."""
        run = min(run, len(words))
        covered: dict[int, set[int]] = {}
        for k in range(len(words) - run + 1):
            for no in self.run(words[k : k + run]):
                covered.setdefault(no, set()).update(range(k, k + run))
        return {no: len(at) for no, at in covered.items()}


def differing(a: list[str], b: list[str], limit: int) -> int:
    """Words to insert, delete or replace to get from a to b (a swap of letters is one replaced word); above limit, limit + 1."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
        if min(row) > limit:
            return limit + 1
    return row[-1]


class Accepted:
    """Accepted records, in segments whose sizes at least halve from one to the next."""

    def __init__(self) -> None:
        self.segments: list[Segment] = []
        self.batch: list[tuple[int, list[str]]] = []

    def close_batch(self) -> None:
        if self.batch:
            self.segments.append(Segment(self.batch))
            self.batch = []
        while len(self.segments) > 1 and len(self.segments[-1].records) * 2 > len(self.segments[-2].records):
            last = self.segments.pop()
            self.segments.append(Segment(self.segments.pop().records + last.records))

    def find(self, words: list[str], run: int, share: float, limit: int) -> int | None:
        """The earliest record that differs in at most ``limit`` words."""
        candidates = list(self.batch)  # not yet a segment
        for segment in self.segments:
            candidates += [segment.records[no] for no, n in segment.coverage(words, run).items() if n >= share * len(words)]
        return min((record for record, theirs in candidates if differing(words, theirs, limit) <= limit), default=None)


class History:
    """Accepted records of one cell by their file: a record is held against those of its own file and of none."""

    def __init__(self) -> None:
        self.by_file: dict[str | None, Accepted] = {}
        self.touched: set[str | None] = set()

    def close_batch(self) -> None:
        for file in self.touched:
            self.by_file[file].close_batch()
        self.touched.clear()

    def find(self, words: list[str], file: str | None, run: int, share: float, few: float) -> int | None:
        """The earliest accepted record of the same defect; without a file it may be any file's."""
        limit = max(1, int(few * len(words)))
        places = self.by_file.values() if file is None else [self.by_file[f] for f in (file, None) if f in self.by_file]
        return min((record for place in places if (record := place.find(words, run, share, limit)) is not None), default=None)

    def accept(self, record: int, words: list[str], file: str | None) -> None:
        self.by_file.setdefault(file, Accepted()).batch.append((record, words))
        self.touched.add(file)


def _fold(run: int, share: float, few: float):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, history, batch = None, History(), None
        for pdf in batches:
            rows = []
            for c, b, first, file, plain, known in zip(*(pdf[c].tolist() for c in ("_cell", "_batch", "_first", "_file", "_plain", "_known")), strict=True):
                if c != cell:
                    cell, history, batch = c, History(), b
                elif b != batch:
                    history.close_batch()
                    batch = b
                words = plain.split(" ")
                if known:
                    history.accept(first, words, file)
                    continue
                kept = history.find(words, file, run, share, few)
                if kept is None:
                    history.accept(first, words, file)
                rows.append((first, first if kept is None else kept))
            yield pd.DataFrame(rows, columns=["_first", "kept_id"])

    return fold


def own_path(path: Column) -> Column:
    """A path from its first own folder on, lower-cased: without machine, workspace and ``src``."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(path, r"\\", "/")), ROOTS, ""), r"^(?:\./|src/)+", "")


def plain_words(text: Column) -> Column:
    """Words without case, spacing, punctuation and everything that holds a digit (numbers, dates, ids, positions)."""
    letters = F.regexp_replace(F.lower(text), r"(?<![\p{L}\p{N}_])[\p{L}_]*+\p{N}[\p{L}\p{N}_]*+", " ")
    return F.trim(F.regexp_replace(letters, r"[^\p{L}]++", " "))


_API = r"(?<![\w.])(?:" + "|".join(re.escape(a.lower()) for a in PLAIN_APIS) + r")(?![\w.]*+\w)"


def mentioned_names(text: Column) -> Column:
    """Sorted lower-cased names in a text: words with an inner capital and the plain APIs."""
    inner = F.regexp_extract_all(text, F.lit(r"(?<!\w)[A-Za-z]\w*?[a-z][A-Z]\w*+"), F.lit(0))
    apis = F.regexp_extract_all(F.lower(text), F.lit(_API), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(F.transform(inner, F.lower), apis)))


def _in_cells(reports: DataFrame, spelt_before: DataFrame | None = None) -> DataFrame:
    """(info_id, _batch, _plain, _file, _cell) of every report with an id and words; spelt_before has names (word) of earlier reports."""
    path = F.coalesce(F.col("loc.file_path"), F.nullif(F.regexp_extract("stack", r"\(([^()]+?):\d+:\d+\)", 1), F.lit("")))
    r = reports.filter("info_id is not null and description is not null")
    r = r.select("info_id", F.coalesce("batch_no", F.lit(0)).alias("_batch"), plain_words(F.col("description")).alias("_plain"), own_path(path).alias("_file"), F.lower(F.trim("component")).alias("_component"), F.col("description").alias("_text"))
    # texts in which case tells nothing (all upper, all lower, swapped): their names are the words that are names elsewhere
    shouted = ~F.col("_text").rlike("[a-z][A-Z]") | (F.length(F.regexp_replace("_text", "[^A-Z]", "")) > F.length(F.regexp_replace("_text", "[^a-z]", "")))
    r = r.filter("_plain <> ''").withColumn("_shouted", shouted)
    r = r.withColumn("_names", mentioned_names(F.when(F.col("_shouted"), F.lower("_text")).otherwise(F.col("_text")))).drop("_text")
    r = cut(r)
    spelt = r.filter("not _shouted").select(F.explode("_names").alias("word"))
    spelt = (spelt.union(spelt_before.select("word")) if spelt_before is not None else spelt).distinct()
    lost = r.filter("_shouted")
    words = lost.select("_plain", F.explode(F.array_distinct(F.split("_plain", " "))).alias("word")).distinct()
    names = words.join(spelt, "word", "left_semi").groupBy("_plain").agg(F.collect_set("word").alias("_more"))
    # the component is named beside the text too, where no slip of the pen has spoilt it
    more = F.concat("_names", F.coalesce("_more", F.array()), F.array("_component"))
    lost = lost.join(names, "_plain", "left").withColumn("_names", F.array_sort(F.array_distinct(F.array_compact(more)))).drop("_more")
    r = r.filter("not _shouted").unionByName(lost)
    return r.select("info_id", "_batch", "_plain", "_file", F.array_join("_names", " ").alias("_cell"))


_KEY = ("_cell", "_path", "_plain")


def _firsts(r: DataFrame) -> DataFrame:
    """Reports that are equal but for volatile details: one row, with the first of them."""
    firsts = r.groupBy("_cell", F.coalesce("_file", F.lit("")).alias("_path"), "_plain").agg(F.min(F.struct("_batch", "info_id")).alias("_f"))
    return firsts.select("_cell", "_plain", F.nullif("_path", F.lit("")).alias("_file"), F.col("_f._batch").alias("_batch"), F.col("_f.info_id").alias("_first"))


def _kept(firsts: DataFrame, known: DataFrame | None, run: int, share: float, few: float) -> DataFrame:
    """(_first, kept_id): cell by cell and batch by batch against what was accepted before, and against ``known``."""
    rows = firsts.withColumn("_known", F.lit(False))
    if known is not None:
        rows = rows.unionByName(known.withColumn("_known", F.lit(True)))
    cells = rows.withColumn("_n", F.count("*").over(Window.partitionBy("_cell")))
    alone = cells.filter("_n = 1 and not _known").select("_first", F.col("_first").alias("kept_id"))
    several = cells.filter("_n > 1").repartition("_cell").sortWithinPartitions("_cell", F.desc("_known"), "_batch", "_first").select("_cell", "_batch", "_first", "_file", "_plain", "_known")
    return alone.union(several.mapInPandas(_fold(run, share, few), "_first bigint, kept_id bigint"))


def _links(r: DataFrame, firsts: DataFrame, kept: DataFrame) -> DataFrame:
    key = [F.col("_cell"), F.coalesce("_file", F.lit("")).alias("_path"), F.col("_plain")]
    mine = r.select("info_id", *key).join(firsts.select(*key, "_first"), list(_KEY))
    return mine.join(kept, "_first").groupBy("info_id").agg(F.min("kept_id").alias("kept_id"))


def same_defects(reports: DataFrame, *, run: int = 3, share: float = 0.2, few: float = 0.35) -> DataFrame:
    """(info_id, kept_id) for every report with an id and a description; kept_id = info_id for the first of a defect.

    Reports are taken batch by batch, in the order of info_id.  ``few`` is the share of words that may differ, ``run`` and
    ``share`` say what a candidate must have in common.  The file is that of loc, else of the stack's first line; a report
    without any file is of the defect that its wording says.  Null batch numbers count as history (batch 0); null or blank
    descriptions repeat nothing and are left out, as are null ids; repeated rows count once; other columns are ignored.
    """
    r = _in_cells(reports)
    firsts = _firsts(r)
    return _links(r, firsts, _kept(firsts, None, run, share, few))


#: Table of accepted reports, one row per defect and wording that no earlier one covers.
ACCEPTED = "cell string, plain string, file string, batch_no int, info_id bigint"


def accept_batch(accepted: DataFrame, reports: DataFrame, *, run: int = 3, share: float = 0.2, few: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """A new batch against the accepted reports of all earlier ones: ((info_id, kept_id), rows to add to ``accepted``).

    The history itself is not read again, and of ``accepted`` only the cells that the batch touches; append the second
    table to it (a folder of parquet, say) before the next batch comes.
    """
    r = _in_cells(reports, accepted.select(F.explode(F.split("cell", " ")).alias("word")).filter("word <> ''"))
    firsts = cut(_firsts(r))
    known = accepted.select(F.col("cell").alias("_cell"), F.col("plain").alias("_plain"), F.col("file").alias("_file"), F.col("batch_no").alias("_batch"), F.col("info_id").alias("_first"))
    known = known.join(firsts.select("_cell").distinct(), "_cell", "left_semi")
    kept = cut(_kept(firsts, known, run, share, few))
    new = firsts.join(kept.filter("_first = kept_id").select("_first"), "_first", "left_semi")
    return _links(r, firsts, kept), new.select(F.col("_cell").alias("cell"), F.col("_plain").alias("plain"), F.col("_file").alias("file"), F.col("_batch").cast("int").alias("batch_no"), F.col("_first").alias("info_id"))


def repeated_reports(reports: DataFrame, **options) -> DataFrame:
    """(kept_id, repeat_id), distinct: reports of a defect that an earlier report has already named."""
    return same_defects(reports, **options).filter("kept_id <> info_id").select("kept_id", F.col("info_id").alias("repeat_id"))


def merged_reports(reports: DataFrame, **options) -> DataFrame:
    """One row per defect: kept_id, reports, first_detected, last_detected, occurrence_count.

    A report with first and last swapped counts the right way round; null counts as no occurrence, null times as unknown.
    """
    once = reports.dropDuplicates(["info_id"])
    times = once.select("info_id", F.least("first_detected", "last_detected").alias("a"), F.greatest("first_detected", "last_detected").alias("b"), F.coalesce("occurrence_count", F.lit(0)).alias("n"))
    merged = same_defects(reports, **options).join(times, "info_id")
    return merged.groupBy("kept_id").agg(F.count("*").alias("reports"), F.min("a").alias("first_detected"), F.max("b").alias("last_detected"), F.sum("n").alias("occurrence_count"))
