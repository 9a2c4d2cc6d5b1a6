"""A log with roll-ups that follow it (T01 / A54 without rebuilding derived tables).

``pair_days`` and ``pair_months`` are counts, minima and maxima, so a batch's roll-up
merges into the stored one: an append reads and rewrites the months it touches, in
the log and in both roll-ups, and no other.  Every relation of ``AudienceModel`` that
the roll-ups determine (all but the log itself and the 90-day RFM slice) is then read
from them, so no old month of the log is scanned again.

A batch passes four steps: its new rows are written to a staging folder, appended
to the log, merged into the roll-ups, and the staging folder goes.  If the job is lost
in between, the next ``append`` or ``recover`` finds the staged batch, adds what the
log still lacks of it and recomputes the touched months from the log, so a batch
counts once whenever it was cut off.

Distinct users are kept as bitmaps by month (``fanlens.operators.bitmaps``), which
are maintained in the same way.
"""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanlens.functions.time import day_start, month_start
from fanlens.operators import base, bitmaps
from fanlens.operators.ingest import KEYS, LOG_SCHEMA, new_rows
from fanlens.params import Params
from fanlens.plans.model import AudienceModel
from fanlens.sources import partitions
from fanlens.sources.interactions import conform

_PAIR = [T.StructField("uid", T.LongType()), T.StructField("entity", T.LongType())]
_SPAN = [T.StructField("first_ts", T.TimestampNTZType()), T.StructField("last_ts", T.TimestampNTZType())]
_MONTH = T.StructField("month", T.TimestampNTZType())
_COUNT = T.StructField("n", T.LongType())
DAYS_SCHEMA = T.StructType([*_PAIR, T.StructField("day", T.TimestampNTZType()), _COUNT, T.StructField("n0", T.LongType()), *_SPAN, _MONTH])
MONTHS_SCHEMA = T.StructType([*_PAIR, _COUNT, *_SPAN, _MONTH])


def in_months(months: list) -> Column:
    """The partitions of ``months``, a batch's calendar months (null included)."""
    known = F.col("month").isin([m for m in months if m is not None])
    return known | F.col("month").isNull() if None in months else known


def day_rows(log: DataFrame) -> DataFrame:
    """Every event as a row of ``pair_days`` with the month, to be merged."""
    day = day_start("ts")
    at_midnight = F.when(F.col("ts") == day, 1).otherwise(0).cast("bigint")
    return log.select(
        "uid", "entity", day.alias("day"), F.lit(1).cast("bigint").alias("n"), at_midnight.alias("n0"),
        F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), month_start(day).alias("month"),
    )


def merge_days(stored: DataFrame, more: DataFrame) -> DataFrame:
    """Two ``pair_days`` with their month (or ``day_rows``) as one."""
    return stored.unionByName(more).groupBy("uid", "entity", "day", "month").agg(
        F.sum("n").alias("n"), F.sum("n0").alias("n0"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )


def roll_up(log: DataFrame) -> DataFrame:
    """``pair_days`` of a log, with the month."""
    return base.pair_days(log, by_user=False).withColumn("month", month_start("day"))


def lacking(log: DataFrame, staged: DataFrame) -> DataFrame:
    """Rows of ``staged`` that ``log`` does not hold yet, as often as they are missing."""
    keys = [*KEYS, "month"]
    want = staged.groupBy(*keys).agg(F.count("*").alias("want"))
    have = log.groupBy(*[F.col(k).alias(f"has_{k}") for k in keys]).agg(F.count("*").alias("have"))
    both = want.join(have, [want[k].eqNullSafe(have[f"has_{k}"]) for k in keys], "left")
    gap = F.col("want") - F.coalesce("have", F.lit(0))
    return both.where(gap > 0).select(*keys, F.explode(F.array_repeat(F.lit(0), gap.cast("int"))).alias("copy")).drop("copy")


class MaintainedLog:
    """The log, its roll-ups and the users' bitmaps below one folder."""

    def __init__(self, spark: SparkSession, path: str, with_bitmaps: bool = False, hash_ranges: int = bitmaps.HASH_RANGES):
        self.spark = spark
        self.log_path, self.days_path, self.months_path, self.staged_path = (
            os.path.join(path, name) for name in ("log", "pair_days", "pair_months", "batch")
        )
        self.users = bitmaps.UserBitmaps(spark, path, hash_ranges) if with_bitmaps else None

    def log(self) -> DataFrame:
        return partitions.read_or_empty(self.spark, self.log_path, LOG_SCHEMA)

    def pair_days(self) -> DataFrame:
        return partitions.read_or_empty(self.spark, self.days_path, DAYS_SCHEMA)

    def pair_months(self) -> DataFrame:
        return partitions.read_or_empty(self.spark, self.months_path, MONTHS_SCHEMA)

    def model(self, params: Params = Params(), dim: DataFrame | None = None) -> AudienceModel:
        """Every derived relation, over the stored roll-ups."""
        return AudienceModel(self.log(), params, dim=dim, roll_ups=(self.pair_days(), self.pair_months()))

    def append(self, batch: DataFrame, dedup: bool = False) -> int:
        """Append the rows of ``batch`` whose (uid, ts, entity) the log lacks; returns their number.

        ``dedup``: also drop repeats within the batch.  A batch without new rows changes nothing."""
        self.recover()
        held = conform(batch).persist(StorageLevel.MEMORY_AND_DISK)  # read twice: its months, then its rows
        try:
            rows = new_rows(self.log(), held, dedup).select(*[f.name for f in LOG_SCHEMA])
            rows.write.mode("overwrite").parquet(self.staged_path)
        finally:
            held.unpersist()
        staged = self.spark.read.schema(LOG_SCHEMA).parquet(self.staged_path)
        n = staged.count()
        if n:
            months = self._months(staged)
            partitions.write_partitions(staged, self.log_path, "month")
            self._replace(merge_days(self.pair_days().where(in_months(months)), day_rows(staged)), months)
        partitions.delete(self.spark, self.staged_path)
        return n

    def recover(self) -> bool:
        """Finish a batch that was cut off; True if there was one."""
        partitions.finish(self.spark, self.days_path, DAYS_SCHEMA, "month")
        partitions.finish(self.spark, self.months_path, MONTHS_SCHEMA, "month")
        whole = partitions.complete(self.spark, self.staged_path)
        if whole:
            staged = self.spark.read.schema(LOG_SCHEMA).parquet(self.staged_path)
            months = self._months(staged)
            if months:
                partitions.write_partitions(lacking(self.log().where(in_months(months)), staged), self.log_path, "month")
                self._replace(roll_up(self.log().where(in_months(months))), months)
        if partitions.exists(self.spark, self.staged_path):
            partitions.delete(self.spark, self.staged_path)
        return whole

    def _replace(self, days: DataFrame, months: list) -> None:
        partitions.replace_partitions(days.select(*[f.name for f in DAYS_SCHEMA]), self.days_path, "month")
        rolled = base.pair_months(self.pair_days().where(in_months(months)))
        partitions.replace_partitions(rolled.select(*[f.name for f in MONTHS_SCHEMA]), self.months_path, "month")
        if self.users:
            self.users.replace(self.pair_months().where(in_months(months)))

    @staticmethod
    def _months(staged: DataFrame) -> list:
        return [r["month"] for r in staged.select("month").distinct().collect()]  # calendar months of one batch
