"""Source trees, JSON documents and configuration as tables, and writes that readers never see half done."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.functions import text as T

#: What a scan reads and what it never enters.
EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".vue", ".svelte")
NEVER = ("node_modules/", "dist/", "build/")


def scan(spark: SparkSession, root: str, *, extensions: tuple[str, ...] = EXTENSIONS, ignore: list[str] | None = None) -> DataFrame:
    """(file_path, source_code, size_bytes, mtime_ts) of every script below a folder; paths are relative to it.

    The extension filter is pushed into the listing, contents are read only where they are used.
    """
    glob = "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*", "/")
    path = T.relative(path, F.lit(root.removeprefix("file:").rstrip("/")))
    files = files.select(path.alias("file_path"), F.decode("content", "UTF-8").alias("source_code"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime_ts"))
    return files.filter(~T.excluded(F.concat(F.lit("/"), F.col("file_path")), [f"/{n}" for n in NEVER] + list(ignore or [])))


def rule_files(files: DataFrame) -> DataFrame:
    """Files that hold rules: ``*.rule.js`` and ``*.rule.ts``, no tests."""
    p = F.col("file_path")
    return files.filter(p.rlike(r"\.rule\.(js|ts)$") & ~p.rlike(r"\.(test|spec)\."))


def exists(spark: SparkSession, path: str) -> bool:
    """The path is there, on whatever file system it names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def json_or(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Documents of a JSON file or folder; none at all if it is missing, broken ones left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    parsed = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    return parsed


def settings(*layers: dict | None) -> dict:
    """Configuration from its layers, later ones win; objects within are merged one level deep, lists replaced."""
    out: dict = {}
    for layer in layers:
        for key, value in (layer or {}).items():
            out[key] = {**out[key], **value} if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def swap_in(df: DataFrame, path: str, *, form: str = "parquet") -> None:
    """Writes beside the target and moves it there, so that a reader finds the old table or the new one.

    The old table is kept aside until the new one stands, and put back if that fails; safe if df reads the old one.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").format(form).save(f"{path}.new")
    jvm = spark._jvm.org.apache.hadoop.fs
    new, old, target = jvm.Path(f"{path}.new"), jvm.Path(f"{path}.old"), jvm.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(new, target):
        fs.rename(old, target)
        raise OSError(f"can't move the new table to {path}")
    fs.delete(old, True)


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as one JSON text; nulls are written too."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(column))


def html_report(title: str, summary: dict[str, object], rows: list[tuple], header: tuple[str, ...]) -> str:
    """A page from a summary and a ranked table, both small by how they were made; all texts are escaped."""
    from html import escape

    facts = "".join(f"<li>{escape(str(k))}: {escape(str(v))}</li>" for k, v in summary.items())
    head = "".join(f"<th>{escape(h)}</th>" for h in header)
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><ul>{facts}</ul><table><tr>{head}</tr>{body}</table></body></html>"


def pretty(value: object) -> str:
    """JSON with an indent of two."""
    return json.dumps(value, indent=2, ensure_ascii=False)


def console_level(text: Column) -> Column:
    """Severity that a console line names: critical, high, medium or low; null if it isn't a security line."""
    level = F.lower(F.regexp_extract(text, r"(?i)^\[SECURITY\]\s*(?:\[?(critical|high|medium|low)\]?)?", 1))
    return F.when(text.rlike(r"(?i)^\[SECURITY\]"), F.when(level == "", "medium").otherwise(level))
