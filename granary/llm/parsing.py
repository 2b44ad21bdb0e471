"""Source files that the grammar of their extension rejects, per file and as rates.

Scale: rows are independent, nothing is shuffled to find errors; equal texts within a batch are parsed once, all files of
a batch side by side (``granary.scripts.parser``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.scripts.parser import SCRIPTS, errors, extension


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        once = pdf[["file_path", "source_code"]].assign(ext=[extension(p or "") for p in pdf["file_path"]])
        which, firsts = pd.factorize(pd.MultiIndex.from_frame(once[["ext", "source_code"]]))
        lines = errors([f"x.{ext}" for ext, _ in firsts], [text for _, text in firsts])
        yield pd.DataFrame({"file_id": pdf["file_id"], "error_line": pd.array([lines[k] for k in which], "Int64")})


def parsed(files: DataFrame) -> DataFrame:
    """(file_id, error_line) of every file whose extension has a grammar; a null line where the grammar takes the file.

    Null code, null paths and null ids are left out; an empty script is right, empty JSON isn't; repeated rows give
    repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    known = "|".join([*SCRIPTS, "json"])
    files = files.select("file_id", "file_path", "source_code").filter("file_id is not null and source_code is not null").filter(F.col("file_path").rlike(rf"(?i)\.(?:{known})$"))
    return files.mapInPandas(_check, "file_id bigint, error_line long")


def rejected_files(files: DataFrame) -> DataFrame:
    """(file_id, error_line), distinct: files that their grammar rejects, with the line of the first error."""
    return parsed(files).filter("error_line is not null").distinct()


def rejection_rates(files: DataFrame) -> DataFrame:
    """Per repo and lang: files with a grammar, rejected ones and their share; null repos and langs are groups of their own."""
    once = files.select("file_id", "repo", "lang").distinct()
    bad = parsed(files).groupBy("file_id").agg(F.max(F.col("error_line").isNotNull().cast("int")).alias("bad"))
    return once.join(bad, "file_id").groupBy("repo", "lang").agg(F.count("*").alias("files"), F.sum("bad").alias("rejected")).withColumn("rate", F.round(F.col("rejected") / F.col("files"), 6))
