"""Incremental ingestion of the interaction log (A54 / T01) and landed feeds.

The reference pulls one JSON reply per user over HTTP and rewrites its whole
Parquet file.  Here replies are *landed files* (one JSON line per user:
``{"uid": .., "body": "{\\"data\\": [{\\"lastLiveDate\\": ms, \\"uId\\": id}]}"}``),
parsed with ``from_json`` + ``explode``, and new rows are *appended* to a
``month``-partitioned log after a left-anti join on (uid, ts, entity) — never a
read-and-overwrite of the same path.  The batch's months, a short list, are a
literal filter on the log, so an append reads only the partitions it can touch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanlens.functions.time import epoch_millis, month_start, to_event_time
from fanlens.sources.interactions import INTERACTION_SCHEMA, conform
from fanlens.sources.sinks import path_missing

KEYS = ["uid", "ts", "entity"]
LOG_SCHEMA = T.StructType([*INTERACTION_SCHEMA.fields, T.StructField("month", T.TimestampNTZType())])

# the feed's wire format (fixed values)
FEED_ITEM = T.StructType([T.StructField("lastLiveDate", T.LongType()), T.StructField("uId", T.LongType())])
FEED_BODY = T.StructType([T.StructField("data", T.ArrayType(FEED_ITEM))])
FEED_SCHEMA = T.StructType([T.StructField("uid", T.LongType()), T.StructField("body", T.StringType())])


def parse_feed(landed: DataFrame) -> DataFrame:
    """Landed replies -> (uid, entity, ts); items lacking a field are dropped."""
    items = landed.select("uid", F.explode(F.from_json("body", FEED_BODY)["data"]).alias("it"))
    return conform(
        items.filter(F.col("it.lastLiveDate").isNotNull() & F.col("it.uId").isNotNull()).select(
            "uid", F.col("it.uId").alias("entity"), to_event_time(F.col("it.lastLiveDate")).alias("ts")
        )
    )


def render_feed(ia: DataFrame) -> DataFrame:
    """Replies as the feed would send them: every event an item, a reply for each user and hour."""
    item = F.struct(epoch_millis("ts").alias("lastLiveDate"), F.col("entity").alias("uId"))
    replies = ia.groupBy("uid", F.date_trunc("hour", "ts").alias("hour"))
    return replies.agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("body")).select("uid", "body")


def new_rows(log: DataFrame, batch: DataFrame, dedup: bool = False) -> DataFrame:
    """Rows of ``batch`` whose (uid, ts, entity) is not in ``log`` (null-safe)."""
    b = batch.dropDuplicates(KEYS) if dedup else batch
    months = [r["month"] for r in batch.select(month_start("ts").alias("month")).distinct().collect()]  # calendar months of one batch
    near = log.filter(F.col("month").isin([m for m in months if m is not None]) | (F.col("month").isNull() if None in months else F.lit(False)))
    near = near.select(*KEYS)  # the month follows from the time, so neither side shuffles it
    return b.join(near, [b[k].eqNullSafe(near[k]) for k in KEYS], "left_anti").withColumn("month", month_start("ts"))


def incremental_append(spark: SparkSession, log_path: str, batch: DataFrame, dedup: bool = False) -> int:
    """Append the new rows of ``batch`` to the log at ``log_path``; returns the count.

    An empty batch is a no-op."""
    try:
        log = spark.read.schema(LOG_SCHEMA).parquet(log_path)
    except AnalysisException as e:
        if not path_missing(e):
            raise
        log = spark.createDataFrame([], LOG_SCHEMA)  # first write
    fresh = new_rows(log, conform(batch), dedup).persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").partitionBy("month").parquet(log_path)
        return n
    finally:
        fresh.unpersist()


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.parquet(log_path).select(*[f.name for f in INTERACTION_SCHEMA.fields])
