"""Parquet tables of which whole partitions are replaced: staged beside the table, then swapped in.

A replacement is first written in full to ``<path>.staged`` (it may read the table
itself) and only then copied over its partitions by a dynamic partition overwrite;
other partitions keep their files.  A job that is lost before the staged copy is
complete has changed nothing; one that is lost later is finished by the next
``finish``, which may run any number of times.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fanlens.sources.sinks import path_missing


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was committed."""
    return exists(spark, f"{path}/_SUCCESS")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``; no rows before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if not path_missing(e):
            raise
        return spark.createDataFrame([], schema)


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Append; few files a partition; one with a third of all rows is split again by the rebalancing."""
    df.hint("rebalance", by).write.mode("append").option("partitionOverwriteMode", "static").partitionBy(by).parquet(path)


def finish(spark: SparkSession, path: str, schema: T.StructType, by: str) -> bool:
    """Swap in what a former replacement staged; drop an incomplete one.  True if there was something to swap."""
    staged = f"{path}.staged"
    whole = complete(spark, staged)
    if whole:  # its files are few a partition already: they are copied without a shuffle
        spark.read.schema(schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    if exists(spark, staged):
        delete(spark, staged)
    return whole


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Put the partitions of ``df`` (all rows of each) in place of those at ``path``."""
    spark, staged = df.sparkSession, f"{path}.staged"
    if exists(spark, staged):
        delete(spark, staged)
    write_partitions(df, staged, by)
    finish(spark, path, df.schema, by)
