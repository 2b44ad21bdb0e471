"""Build assets (asset, size): which count, totals, packages, growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_asset(path: Column) -> Column:
    """Scripts and style sheets, no source maps."""
    return path.rlike(r"\.(?:js|css)$") & ~path.endswith(".map")


def oversize(assets: DataFrame, limit_bytes: int) -> DataFrame:
    """Assets above the limit; one of just that size is not over."""
    return assets.filter(F.col("size") > limit_bytes)


def totals(assets: DataFrame, limit_bytes: int) -> DataFrame:
    return assets.agg(F.count("*").alias("assets"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.count_if(F.col("size") > limit_bytes).alias("over"))


def package_name(path: Column) -> Column:
    """The package of a module path below node_modules, with its scope; null elsewhere."""
    return F.nullif(F.regexp_extract(path, r"node_modules/((?:@[^/]+/)?[^/]+)", 1), F.lit(""))


def sizes_by_package(modules: DataFrame) -> DataFrame:
    return modules.groupBy(F.coalesce(package_name(F.col("path")), F.lit("(own)")).alias("package")).agg(F.sum("size").alias("bytes"), F.count("*").alias("modules"))


def largest(assets: DataFrame, n: int = 5) -> DataFrame:
    return assets.orderBy(F.desc("size"), "path").limit(n)


def change_to_history(assets: DataFrame, history: DataFrame) -> DataFrame:
    """Size against the last build's; new assets have no change."""
    old = history.select("path", F.col("size").alias("before"))
    return assets.join(old, "path", "left").select("path", "size", "before", (F.col("size") - F.col("before")).alias("change"))
