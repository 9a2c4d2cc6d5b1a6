"""Places in a whole order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanlens.session import ensure_checkpoint_dir


def numbered(df: DataFrame, by: str, place: str) -> DataFrame:
    """``df`` with ``place`` (long, from 0) in the order of ``by``.

    Rows are cut into ranges of ``by``, sorted there, and numbered by the sizes of the
    ranges before; equal values are numbered in any order."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    rows = rows.withColumn("_run", F.shiftright("_at", 33))
    runs = rows.groupBy("_run").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_run")) - F.col("_n") - F.col("_first")  # one row a range
    return rows.join(F.broadcast(runs.select("_run", before.alias("_shift"))), "_run").withColumn(place, F.col("_at") + F.col("_shift")).drop("_at", "_run", "_shift")
