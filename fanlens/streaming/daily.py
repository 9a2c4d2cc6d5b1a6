"""Daily weak / strong / total event counts as a streaming aggregation.

Event time is the UTC instant of the log's wall clock, so 1-day tumbling
windows are calendar days.  The aggregation runs in ``update`` mode without a
watermark: its state is one row a calendar day, so a day of any age can still be
updated and a backfill equals the batch.  Each
micro-batch's updated rows are appended with their batch id and readers take
the latest version per day — an upsert on append-only storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fanlens.functions.time import as_utc_instant, utc_wallclock
from fanlens.params import ROAMING


def daily_type_stream(rows: DataFrame) -> DataFrame:
    """Streaming (or batch) frame of (day, weak, strong, total) updates."""
    et = rows.withColumn("event_time", as_utc_instant("ts"))
    e = F.col("entity")
    return et.groupBy(F.window("event_time", "1 day").alias("w")).agg(
        F.sum(F.when(e == ROAMING, 1).otherwise(0)).cast("bigint").alias("weak"),
        F.sum(F.when(e != ROAMING, 1).otherwise(0)).cast("bigint").alias("strong"),
        F.count(F.lit(1)).alias("total"),
    ).select(utc_wallclock(F.col("w.start")).alias("day"), "weak", "strong", "total")


def run_daily_type(spark: SparkSession, rows: DataFrame, out_path: str, checkpoint: str):
    agg = daily_type_stream(rows)

    def sink(batch, epoch_id):
        batch.withColumn("batch_id", F.lit(epoch_id).cast("bigint")).write.mode("append").parquet(out_path)

    q = (
        agg.writeStream.outputMode("update")
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def read_daily_type(spark: SparkSession, out_path: str) -> DataFrame:
    """Latest version of every day."""
    df = spark.read.parquet(out_path)
    w = Window.partitionBy("day").orderBy(F.col("batch_id").desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("day", "weak", "strong", "total")
