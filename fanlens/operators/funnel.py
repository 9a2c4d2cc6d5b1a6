"""AARRR funnel per (entity, first-touch month).

Windows start at the first-touch *month start* M (not at the first event):
activation = an event of the pair in [M, M+7d]; early retention = an event in
[M+27d, M+33d]; revenue proxy = events of the pair in [M, M+30d].  All ends are
inclusive.

A window reaches at most into the month after M, so each month of a pair carries its
events in the windows of its own start and in those of the month before.  A pair's
first month is its smallest one; the month after it, if the pair has it, is the
smallest of the other parity.  Minima of (month number, counts) by parity thus give
both, as longs in a hash aggregation: the days of a pair are neither sorted nor joined
with its first month.  Grains whose windows reach further take the first period by a
window over the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanlens.functions.math import ratio
from fanlens.functions.time import add_days, add_periods, period_index, period_start
from fanlens.params import Params


def _in_window(lo_days: int, hi_days: int, m: Column) -> Column:
    """Events of the pair_days row inside [m+lo, m+hi] (both midnights, inclusive)."""
    day = F.col("day")
    whole = (day >= add_days(m, lo_days)) & (day < add_days(m, hi_days))
    edge = day == add_days(m, hi_days)
    return F.when(whole, F.col("n")).when(edge, F.col("n0")).otherwise(F.lit(0))


#: days of the shortest period of a grain
SHORTEST = {"day": 1, "week": 7, "month": 28, "quarter": 90, "year": 365}
COUNT_BITS = 40  # of a count of a pair's events in one period


def pair_funnel(pd_: DataFrame, p: Params = Params()) -> DataFrame:
    """(uid, entity, month, activ, reten, revenue) — one row per pair."""
    if max(p.retention_to_days, p.revenue_days) // SHORTEST[p.grain] > 1:
        return _pair_funnel_over_days(pd_, p)
    month = period_start("day", p.grain).alias("month")
    start = lambda back: add_periods(period_start("day", p.grain), -back, p.grain)
    by_month = pd_.groupBy("uid", "entity", month).agg(
        F.min("first_ts").alias("first_ts"),
        *[F.sum(_in_window(p.retention_from_days, p.retention_to_days, start(k))).alias(f"reten_{k}") for k in (0, 1)],
        *[F.sum(_in_window(0, p.revenue_days, start(k))).alias(f"revenue_{k}") for k in (0, 1)],
    )
    at = period_index("month", p.grain)

    def packed(k: int):
        back = F.shiftleft((F.col(f"reten_{k}") > 0).cast("bigint"), COUNT_BITS)
        return F.shiftleft(at, COUNT_BITS + 1).bitwiseOR(back).bitwiseOR(F.col(f"revenue_{k}"))

    parity = F.pmod(at, F.lit(2))
    pairs = by_month.groupBy("uid", "entity").agg(
        F.min("month").alias("month"),
        F.min("first_ts").alias("first_ts"),
        *[F.min(F.when(parity == c, packed(k))).alias(f"p{c}{k}") for c in (0, 1) for k in (0, 1)],
    )
    first = period_index("month", p.grain)
    # what each parity's smallest month adds: its own windows if it is M, those of M if it is the next one
    found = [
        F.when(F.shiftright(f"p{c}0", COUNT_BITS + 1) == first, F.col(f"p{c}0")).when(F.shiftright(f"p{c}1", COUNT_BITS + 1) == first + 1, F.col(f"p{c}1"))
        for c in (0, 1)
    ]
    flags = [F.coalesce(F.shiftright(x, COUNT_BITS).bitwiseAND(F.lit(1)), F.lit(0)) for x in found]
    counts = [F.coalesce(x.bitwiseAND(F.lit((1 << COUNT_BITS) - 1)), F.lit(0)) for x in found]
    return pairs.select(
        "uid", "entity", "month",
        (F.col("first_ts") <= add_days("month", p.activation_days)).cast("int").alias("activ"),
        F.greatest(*flags).cast("int").alias("reten"),
        (counts[0] + counts[1]).alias("revenue"),
    )


def _pair_funnel_over_days(pd_: DataFrame, p: Params) -> DataFrame:
    first = F.min("first_ts").over(Window.partitionBy("uid", "entity"))
    m = F.col("month")
    return (
        pd_.withColumn("month", period_start(first, p.grain))
        .groupBy("uid", "entity", "month")
        .agg(
            (F.min("first_ts") <= add_days(m, p.activation_days)).cast("int").alias("activ"),
            (F.sum(_in_window(p.retention_from_days, p.retention_to_days, m)) > 0).cast("int").alias("reten"),
            F.sum(_in_window(0, p.revenue_days, m)).alias("revenue"),
        )
    )


def funnel_core(pf: DataFrame) -> DataFrame:
    """acq, activ, reten, revenue per (entity, month)."""
    return pf.groupBy("entity", "month").agg(
        F.count(F.lit(1)).alias("acq"),
        F.sum("activ").cast("bigint").alias("activ"),
        F.sum("reten").cast("bigint").alias("reten"),
        F.sum("revenue").cast("bigint").alias("revenue"),
    )


def acquisition(ft: DataFrame) -> DataFrame:
    """First touches per (entity, month)."""
    return ft.groupBy("entity", "month").agg(F.count(F.lit(1)).alias("acq"))


def activation(core: DataFrame) -> DataFrame:
    """Groups with at least one activated user."""
    return core.filter("activ > 0").select("entity", "month", "activ")


def early_retention(core: DataFrame) -> DataFrame:
    """D15."""
    return core.filter("reten > 0").select("entity", "month", "reten")


def referral(fs: DataFrame, p: Params = Params()) -> DataFrame:
    """Distinct users whose source was this entity, per first-touch month."""
    return (
        fs.filter(F.col("source") != p.sentinel)
        .groupBy(F.col("source").alias("entity"), "month")
        .agg(F.countDistinct("uid").alias("refer"))
    )


def revenue_proxy(core: DataFrame) -> DataFrame:
    """D17."""
    return core.filter("revenue > 0").select("entity", "month", "revenue")


def aarrr_metrics(core: DataFrame, refer: DataFrame) -> DataFrame:
    """Acquisition left-joined to the other four steps, with rates."""
    j = core.join(refer, ["entity", "month"], "left")
    refer_ = F.coalesce(F.col("refer"), F.lit(0).cast("bigint"))
    return j.select(
        "entity",
        "month",
        "acq",
        "activ",
        "reten",
        refer_.alias("refer"),
        "revenue",
        ratio("activ", "acq").alias("activation_rate"),
        ratio("reten", "acq").alias("retention_rate"),
        ratio(refer_, "acq").alias("referral_rate"),
    )
