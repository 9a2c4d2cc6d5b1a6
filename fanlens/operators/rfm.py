"""RFM segmentation (D19-D22) and daily RFM contribution.

Literal scoring rules (kept as the behaviour to reproduce):
recency tests ``<= r80`` before ``<= r20`` (so r is 5 or 1), and monetary is the
event count scored against the frequency quantiles (so m == f).  ``rfm_score_v2``
applies the intended recency order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanlens.functions.joins import join_per_entity
from fanlens.functions.time import add_days, day_diff, month_start
from fanlens.params import (
    RFM_CHURN_RISK,
    RFM_HIGH_VALUE,
    RFM_POTENTIAL,
    RFM_REGULAR,
    Params,
)


def rfm_base(ia: DataFrame, ref_ts: Column, p: Params = Params()) -> DataFrame:
    """Pairs active in the last ``rfm_window_days`` before the latest event.

    With ``ref_ts`` a literal the time filter reaches the Parquet scan, and on a
    ``month``-partitioned log the implied month bound prunes partitions."""
    lo = add_days(ref_ts, -p.rfm_window_days)
    recent = ia.filter(F.col("ts") >= lo)
    if "month" in ia.columns:
        recent = recent.filter(F.col("month") >= month_start(lo))
    return (
        recent.groupBy("uid", "entity")
        .agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("freq"))
        .select(
            "uid",
            "entity",
            day_diff("last_ts", ref_ts).alias("recent_days"),
            "freq",
            F.col("freq").alias("monetary"),
        )
    )


def rfm_thresholds(base: DataFrame, p: Params = Params()) -> DataFrame:
    """Per-entity exact p20 / p80 of recency and frequency."""
    lo, hi = p.rfm_low_quantile, p.rfm_high_quantile
    return base.groupBy("entity").agg(
        F.percentile("recent_days", lo).alias("r20"),
        F.percentile("recent_days", hi).alias("r80"),
        F.percentile("freq", lo).alias("f20"),
        F.percentile("freq", hi).alias("f80"),
    )


def _score_high(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(x >= hi, 5).when(x >= lo, 3).otherwise(1)


def rfm_score(base: DataFrame, qt: DataFrame, intended: bool = False) -> DataFrame:
    """R, f, m in {5, 3, 1}."""
    rd = F.col("recent_days")
    if intended:
        r = F.when(rd <= F.col("r20"), 5).when(rd <= F.col("r80"), 3).otherwise(1)
    else:
        r = F.when(rd <= F.col("r80"), 5).when(rd <= F.col("r20"), 3).otherwise(1)
    return join_per_entity(base, qt).select(
        "uid",
        "entity",
        "recent_days",
        "freq",
        "monetary",
        r.alias("r"),
        _score_high(F.col("freq"), F.col("f20"), F.col("f80")).alias("f"),
        _score_high(F.col("monetary"), F.col("f20"), F.col("f80")).alias("m"),
    )


def rfm_user(score: DataFrame) -> DataFrame:
    """rfm_code (r||f||m) and rfm_tag."""
    r, f, m = F.col("r"), F.col("f"), F.col("m")
    tag = (
        F.when((r >= 4) & (f >= 4) & (m >= 4), RFM_HIGH_VALUE)
        .when((r >= 3) & (f >= 3), RFM_POTENTIAL)
        .when(r <= 2, RFM_CHURN_RISK)
        .otherwise(RFM_REGULAR)
    )
    return score.select("*", F.concat(r.cast("string"), f.cast("string"), m.cast("string")).alias("rfm_code"), tag.alias("rfm_tag"))


def rfm_daily_contribution(pd_: DataFrame, rfm: DataFrame) -> DataFrame:
    """Per (day, rfm_tag, entity): users, events, share of the (day, entity) events."""
    per = (
        pd_.join(rfm.select("uid", "entity", "rfm_tag"), ["uid", "entity"])
        .groupBy("day", "rfm_tag", "entity")
        .agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("events"))
    )
    total = F.sum("events").over(Window.partitionBy("day", "entity"))
    return per.select(
        "day", "rfm_tag", "entity", "users", "events", (F.col("events").cast("double") / total).alias("evt_ratio")
    )
