"""Continuous ingestion of landed feed files into the interaction log.

``readStream`` over the landing folder (JSON lines), parse, drop what came before,
append.  Repeats are dropped twice over:

* in state: an event that arrives again within ``delay`` of its first arrival is
  dropped by ``dropDuplicatesWithinWatermark`` before the log is touched.  The
  watermark is on the time of arrival (the micro-batch's), so nothing is ever late:
  an event of any age gets through once, and state older than ``delay`` is forgotten;
* against the log: what is left is anti-joined with the months of the log it falls
  in, so an event that comes again later, or was in the log before the stream began,
  is dropped as well.

Nothing is lost by the state and nothing is counted twice after it is forgotten.
The state lies in the checkpoint (``spark.sql.streaming.stateStore.providerClass``
names the store, RocksDB for large ones); a stream that starts again there goes on
with the same state, and a micro-batch that runs again finds its rows in the log.
``availableNow`` drains what has landed and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanlens.operators.ingest import FEED_SCHEMA, KEYS, incremental_append, parse_feed

DELAY = "1 day"


def first_arrivals(rows: DataFrame, delay: str = DELAY) -> DataFrame:
    """``rows`` (a stream) without events that arrived before within ``delay``."""
    arrived = rows.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", delay)
    return arrived.dropDuplicatesWithinWatermark(KEYS).drop("arrived")


def stream_into(
    spark: SparkSession, landing: str, append: Callable[[DataFrame], int], checkpoint: str, delay: str | None = DELAY, max_files: int | None = None
):
    """Drain ``landing`` into ``append``, which takes each micro-batch (``incremental_append``, ``MaintainedLog.append``).

    ``delay``: how long arrivals are remembered in state; ``None`` keeps no state."""
    reader = spark.readStream.schema(FEED_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = parse_feed(reader.json(landing))
    rows = first_arrivals(rows, delay) if delay else rows

    def sink(batch, _epoch_id):
        append(batch)

    q = (
        rows.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def stream_append(
    spark: SparkSession, landing: str, log_path: str, checkpoint: str, dedup: bool = True, delay: str | None = DELAY, max_files: int | None = None
):
    """``stream_into`` a plain month-partitioned log; ``dedup`` drops repeats within a micro-batch too."""
    delay = delay if dedup else None

    def append(batch):
        return incremental_append(batch.sparkSession, log_path, batch, dedup=dedup and delay is None)

    return stream_into(spark, landing, append, checkpoint, delay, max_files)
