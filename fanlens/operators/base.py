"""Shared pre-aggregations of the interaction log.

Every operator downstream reads one of these instead of the raw log, so a hot
key (one user or one entity holding a third of all events) is collapsed by the
map-side partial aggregation before any shuffle:

* ``pair_days``   (uid, entity, day): ≤ one row per pair and calendar day
* ``pair_months`` (uid, entity, month): ≤ one row per pair and month
* ``pairs``       (uid, entity): one row per pair

``pair_days`` is re-partitioned by ``uid`` right after the partial + final
aggregation (a hot user is already collapsed to ≤ entities × days rows there),
so every later uid-keyed step — the per-pair and per-month roll-ups, the
label aggregation per user, the flow timelines, the joins with user labels —
reuses that partitioning instead of shuffling again.  Where no relation asked for the
days, ``pair_months`` is rolled up from the log itself and partitioned in the same way.

``pair_days`` keeps ``n0`` (events exactly at midnight) next to ``n`` so that a
closed window ``[a, b]`` whose ends are midnights is still exact at day grain:
it holds all events of days ``a .. b-1`` plus the midnight events of day ``b``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanlens.functions.time import day_start, period_start


def with_month(ia: DataFrame, grain: str = "month") -> DataFrame:
    """The log with its period (the calendar month, unless ``grain`` says otherwise)."""
    return ia.select("uid", "entity", "ts", period_start("ts", grain).alias("month"))


def pair_days(ia: DataFrame, by_user: bool = True) -> DataFrame:
    day = day_start("ts")
    out = ia.groupBy("uid", "entity", day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ts") == day).alias("n0"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    return by_uid(out) if by_user else out


def by_uid(df: DataFrame) -> DataFrame:
    """Hash-partition by user (AQE may coalesce the count; the partitioning is reused downstream)."""
    return df.repartition("uid")


def pair_months(pd_: DataFrame, grain: str = "month") -> DataFrame:
    return pd_.groupBy("uid", "entity", period_start("day", grain).alias("month")).agg(
        F.sum("n").alias("n"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )


def log_months(ia: DataFrame, grain: str = "month") -> DataFrame:
    """``pair_months`` straight from the log, by user: for readings that need no day."""
    out = ia.groupBy("uid", "entity", period_start("ts", grain).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return by_uid(out).sortWithinPartitions("uid", "entity", "month")  # the order that timelines and joins by user need


def log_first_touch(ia: DataFrame, grain: str = "month") -> DataFrame:
    """(uid, entity, month) of each pair's first event, straight from the log."""
    return ia.groupBy("uid", "entity").agg(F.min("ts").alias("first_ts")).select("uid", "entity", period_start("first_ts", grain).alias("month"))


def event_days(ia: DataFrame) -> DataFrame:
    """Every event as a row (day, entity, n = 1): for sums a day that need no user."""
    return ia.select(day_start("ts").alias("day"), "entity", F.lit(1).cast("bigint").alias("n"))


def pairs(pm: DataFrame) -> DataFrame:
    return pm.groupBy("uid", "entity").agg(
        F.min("month").alias("first_month"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.count(F.lit(1)).alias("month_cnt"),
        F.sum("n").alias("n"),
    )
