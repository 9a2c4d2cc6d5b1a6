"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanlens.session import ensure_checkpoint_dir, shared_path

#: A side whose measured size is below this is broadcast; larger sides are joined by shuffle.
BROADCAST_BYTES = 32 << 20


#: Arrow data that a Python worker gets at once: texts are long, and a fixed number of rows has no bound
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's bytes of an Arrow batch to ``BATCH_BYTES``."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
    return df


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it there."""
    path = shared_path(df.sparkSession, name, unique=True)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, row_bytes) -> tuple[DataFrame, bool]:
    """Materialise a small side and tell whether it may be broadcast.

    ``row_bytes``: column with the bytes of a row.  The side is written to the
    shared folder once, its size is summed there, and only one number reaches
    the driver."""
    df = durable(df)
    size = df.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("n")).first()["n"]
    return df, size <= BROADCAST_BYTES


def join_small(left: DataFrame, side: DataFrame, on: list[str], how: str, row_bytes) -> DataFrame:
    """Join a side that is usually small: broadcast after measuring, else shuffled (AQE splits hot keys)."""
    side, small = measured(side, row_bytes)
    return left.join(F.broadcast(side) if small else side, on, how)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fresh(df: DataFrame) -> DataFrame:
    """``df`` under new column identities: one side of a cogroup of two frames of one origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def text_bytes(col) -> F.Column:
    """UTF-8 bytes of a string column; null counts as empty."""
    return F.coalesce(F.octet_length(col), F.lit(0))


def ranked(df: DataFrame, within: list[str], by: list[str], place: str, total: str) -> DataFrame:
    """``df`` with ``place`` (long, from 0, in the order ``by`` within equal ``within``) and ``total`` (rows there).

    ``within`` must not be null.  Rows are cut into ranges of the whole order, so
    one value with a third of all rows is many tasks; only the ranges' counts are
    summed up.  Rows that are equal in ``by`` are numbered in any order."""
    rows = durable(df).withColumn("_tie", F.monotonically_increasing_id())
    order = [*within, *by, "_tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    rows = durable(rows.withColumn("_at", F.monotonically_increasing_id())).withColumn("_run", F.shiftright("_at", 33))
    runs = rows.groupBy(*within, "_run").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of = Window.partitionBy(*within)
    runs = runs.select(
        *within, "_run",
        (F.sum("_n").over(of.orderBy("_run")) - F.col("_n") - F.col("_first")).alias("_shift"),
        F.sum("_n").over(of).alias(total),
    )
    out = join_small(rows, runs, [*within, "_run"], "inner", F.lit(64))
    return out.withColumn(place, F.col("_at") + F.col("_shift")).drop("_at", "_run", "_shift")
