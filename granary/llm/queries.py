"""Queries of the llm operators: name -> (spark, directory) -> DataFrame, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import credentials, handwritten, history, leaks, packing, parsing, spans


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that were generated, minified, vendored or are data."""
    return handwritten.not_handwritten(_read(spark, sf_dir, "source_files")).select("file_id")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repo: files with code, and those that are not hand-written."""
    files = _read(spark, sf_dir, "source_files").filter("source_code is not null").select("file_id", "repo").distinct()
    found = handwritten.not_handwritten(_read(spark, sf_dir, "source_files")).select("file_id", F.lit(1).alias("found"))
    return files.join(found, "file_id", "left").groupBy("repo").agg(F.count("*").alias("files"), F.count("found").alias("not_handwritten"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that the grammar of their extension rejects."""
    return parsing.rejected_files(_read(spark, sf_dir, "source_files")).select("file_id").distinct()


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected files per repo and lang."""
    return parsing.rejection_rates(_read(spark, sf_dir, "source_files"))


def _credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = credentials.credential_lines(_read(spark, sf_dir, "source_files"), "file_id", "source_code", "file_path")
    issues = credentials.credential_lines(_read(spark, sf_dir, "issues"), "issue_id", "code", F.col("loc.file_path"))
    return files.select(F.lit("source_files").alias("origin"), "*").union(issues.select(F.lit("issues").alias("origin"), "*"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of source_code and of issues.code on which a credential begins."""
    return _credentials(spark, sf_dir).select("origin", "row_id", "line_no").distinct()


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials by origin and kind."""
    return _credentials(spark, sf_dir).distinct().groupBy("origin", "kind").agg(F.count("*").alias("lines"), F.countDistinct("row_id").alias("texts"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose code changes when credentials are hidden, with the length before and after (equal) and a digest."""
    files = _read(spark, sf_dir, "source_files").select("file_id", "file_path", "source_code", F.col("source_code").alias("hidden"))
    done = credentials.redacted(files, "hidden", "file_path").filter("hidden <> source_code")
    return done.select("file_id", F.length("source_code").alias("chars"), F.length("hidden").alias("hidden_chars"), F.md5("hidden").alias("hidden_md5"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that repeat the defect of an earlier one."""
    return history.repeated_reports(_read(spark, sf_dir, "issue_infos"))


def p4_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per defect with its times and occurrences."""
    return history.merged_reports(_read(spark, sf_dir, "issue_infos"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, or of each part of a text that is too large, for each kind of container."""
    return packing.packed(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "containers"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and the share of their room that is filled."""
    return packing.fill_rates(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "containers"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with 15 successive words of an evaluation item."""
    return leaks.leaked_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p7_reworked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an evaluation item whose numbers, names or units were replaced."""
    return leaks.reworked_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that share a stretch of 500 characters."""
    return spans.shared_spans(_read(spark, sf_dir, "documents"))


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document stands in lines of earlier documents."""
    return spans.shared_share(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_rates, p3_found, p3_kinds, p3_redacted, p4_found, p4_merged, p6_packed, p6_fill, p7_found, p7_reworked, p8_found, p8_shared)}


_WORDS = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x))"


def oracle_sql() -> dict[str, str]:
    """SQL for what it can say in reasonable time on whole tables."""

    def windows(key: str, table: str) -> str:
        return f"select {key}, unnest(list_transform(range(1, len(w) - 13), lambda i: array_to_string(w[i:i+14], ' '))) g from (select {key}, {_WORDS} w from {table} where text is not null) where len(w) >= 15"

    lines = "select doc_id, n, line, sum(length(line) + 1) over (partition by doc_id order by n) - length(line) - 1 pos from (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from documents where text is not null)"
    units = f"select doc_id, pos, length(line) len, trim(regexp_replace(line, '\\s+', ' ', 'g')) plain from ({lines}) where length(line) >= 40"
    ranked = f"select *, row_number() over (partition by plain order by doc_id, pos) rn from ({units}) where length(plain) >= 40"
    return {
        "p7_found": f"select distinct item_id, doc_id from ({windows('item_id', 'eval_items')}) join ({windows('doc_id', 'documents')}) using (g)",
        "p8_shared": f"select doc_id, cast(length(text) as integer) chars, cast(shared_chars as bigint) shared_chars, shared_lines, round(shared_chars / length(text), 6) share from documents join (select doc_id, sum(len) shared_chars, count(*) shared_lines from ({ranked}) where rn > 1 group by 1) using (doc_id)",
    }
