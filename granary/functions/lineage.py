"""Lineage cuts on storage that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the folder of ``spark.checkpoint.dir``, so that a lost executor loses nothing.

    Only where the session names no folder and none is set, as on a single machine in tests, a temporary one is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="granary-"))
    return df.checkpoint(eager=True)
