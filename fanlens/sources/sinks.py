"""Sinks: Parquet snapshots (D37, I03), CSV export (I04), append-only logs."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def path_missing(e: AnalysisException) -> bool:
    """Whether a read failed because nothing has been written there yet."""
    return e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def table_version(df: DataFrame) -> str:
    """Short digest of what a frame reads: its logical plan, without listing files."""
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    return hashlib.sha1(plan.encode()).hexdigest()[:12]


def snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Materialise ``df`` as Parquet at ``path`` (overwrite) and return the re-read table.

    Writing to the shared folder also cuts the lineage for later consumers."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def read_through(spark, path: str, build, refresh: bool = False) -> DataFrame:
    """Parquet cache at ``path``; built (and written) only when missing or ``refresh``."""
    if not refresh:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if not path_missing(e):
                raise
    return snapshot(build(), path)


def export_csv(df: DataFrame, path: str) -> DataFrame:
    """CSV with a header row (one file per partition)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).schema(df.schema).csv(path)
