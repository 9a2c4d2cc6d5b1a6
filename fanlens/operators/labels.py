"""Fixed / flowing / roaming labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanlens.functions.joins import join_per_entity
from fanlens.functions.time import day_diff
from fanlens.params import FIXED, FLOWING, ROAMING, Params


def first_touch(pairs: DataFrame) -> DataFrame:
    """Month of the first event of every (uid, entity) pair."""
    return pairs.select("uid", "entity", F.col("first_month").alias("month"))


def pair_stats(pairs: DataFrame, ref_ts: Column) -> DataFrame:
    """Distinct active months, last event, day boundaries to the latest event."""
    return pairs.select(
        "uid",
        "entity",
        "month_cnt",
        "last_ts",
        day_diff("last_ts", ref_ts).alias("recency_days"),
    )


def entity_threshold(stats: DataFrame, p: Params = Params()) -> DataFrame:
    """Per-entity exact median of month_cnt and upper quartile of recency.

    Exact ``percentile`` keeps a value->count map per group; both inputs are
    small integers, so the map stays tiny however hot an entity is."""
    return stats.groupBy("entity").agg(
        F.percentile("month_cnt", p.label_month_quantile).alias("month_med"),
        F.percentile("recency_days", p.label_recency_quantile).alias("recency_75"),
    )


def pair_label(stats: DataFrame, thr: DataFrame) -> DataFrame:
    """FIXED if active in at least the median number of months and recent enough."""
    fixed = (F.col("month_cnt") >= F.col("month_med")) & (F.col("recency_days") <= F.col("recency_75"))
    return join_per_entity(stats, thr).select(
        "uid", "entity", F.when(fixed, F.lit(FIXED)).otherwise(F.lit(FLOWING)).alias("label")
    )


def user_global_label(labels: DataFrame) -> DataFrame:
    """FIXED if any pair is FIXED, else ROAMING."""
    lo = F.min("label")
    return labels.groupBy("uid").agg(F.when(lo == FLOWING, F.lit(ROAMING)).otherwise(lo).alias("global_label"))


def pair_label_augmented(labels: DataFrame, glob: DataFrame, p: Params = Params()) -> DataFrame:
    """Pair labels plus one (uid, sentinel, -3) row per roaming user."""
    extra = glob.filter(F.col("global_label") == ROAMING).select(
        "uid", F.lit(p.sentinel).cast("bigint").alias("entity"), F.lit(ROAMING).alias("label")
    )
    return labels.unionByName(extra)


def user_modal_label(aug: DataFrame) -> DataFrame:
    """Most frequent label per user; ties go to the smallest label."""
    return aug.groupBy("uid").agg(F.mode("label", deterministic=True).alias("global_label"))


def user_modal_label_from_pairs(labels: DataFrame) -> DataFrame:
    """D27 computed from D06 directly (same result as ``user_modal_label(D08)``).

    D08 adds exactly one ROAMING row to users without a FIXED pair, so with
    c2 FIXED and c1 FLOWING pairs the mode (ties -> smallest label) is:
    c2 > 0: FIXED if c2 >= c1 else FLOWING; c2 = 0: ROAMING if c1 == 1 else FLOWING.
    A plain hash aggregation per user — no union, no value maps."""
    c2 = F.count_if(F.col("label") == FIXED)
    c1 = F.count_if(F.col("label") == FLOWING)
    modal = (
        F.when(c2 > 0, F.when(c2 >= c1, F.lit(FIXED)).otherwise(F.lit(FLOWING)))
        .when(c1 == 1, F.lit(ROAMING))
        .otherwise(F.lit(FLOWING))
    )
    return labels.groupBy("uid").agg(modal.alias("global_label"))
