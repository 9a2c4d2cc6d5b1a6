"""Cohorts: FIXED-user retention (D25) and the three-stage layer funnel.

Literal behaviour kept (the intended variants are the ``_v2`` functions):

* D25 joins a cohort to activity in *all* months, so month_age can be negative.
* D36 stage 2/3 look for a *second* first-touch row of the same pair, which
  cannot exist (one first touch per pair), and the "fixed" test matches the
  user on any entity.  So only the ``new`` stage has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanlens.functions.math import ratio
from fanlens.functions.time import add_periods, period_diff, period_index
from fanlens.params import FIXED, FUNNEL_STAGES, Params


def cohort_retention(ft: DataFrame, labels: DataFrame, pm: DataFrame, min_age: int | None = None, p: Params = Params()) -> DataFrame:
    """Distinct users of each FIXED first-touch cohort active per month offset.

    ``labels`` is D06 or D08 (only the FIXED rows are used).  A user enters a
    cohort once per cohort month (dedup before the join on uid)."""
    fixed = labels.filter(F.col("label") == FIXED).select("uid", "entity")
    cohort = ft.join(fixed, ["uid", "entity"]).select(F.col("month").alias("cohort_month"), "uid").distinct()
    activity = pm.select("month", "uid").distinct()
    joined = cohort.join(activity, "uid").select("cohort_month", period_diff("cohort_month", "month", p.grain).alias("month_age"))
    if min_age is not None:
        joined = joined.filter(F.col("month_age") >= min_age)
    return joined.groupBy("cohort_month", "month_age").agg(F.count(F.lit(1)).alias("retained"))


def _stage(df: DataFrame, base: DataFrame, idx: int) -> DataFrame:
    # rows come from first touches, unique per (uid, entity): a count is a distinct-user count
    counted = df.groupBy("entity", "cohort_month").agg(F.count(F.lit(1)).alias("users"))
    return base.withColumnRenamed("users", "base_users").join(counted, ["entity", "cohort_month"]).select(
        "entity",
        "cohort_month",
        F.lit(FUNNEL_STAGES[idx]).alias("stage"),
        F.lit(idx + 1).alias("stage_ord"),
        "users",
        ratio("users", "base_users").alias("pct"),
    )


def cohort_layer_funnel(ft: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """D36 (literal): new / month1_fixed / month2_fixed per (entity, cohort_month).

    A pair's first touches meet in a window, its user's label in a join on uid: first touches
    and labels that are partitioned by user are read once and not shuffled, only their counts are."""
    fixed_users = labels.filter(F.col("label") == FIXED).select("uid").distinct().withColumn("fixed", F.lit(True))
    new = ft.select("uid", "entity", F.col("month").alias("cohort_month"), period_index("month", p.grain).alias("mi"))
    pair = Window.partitionBy("uid", "entity").orderBy("mi")
    known = F.col("entity").isNotNull() & F.col("mi").isNotNull()
    for k in (1, 2):  # a first touch k months after the cohort month, same pair
        later = F.count(F.lit(1)).over(pair.rangeBetween(k, k))
        new = new.withColumn(f"later{k}", known & (later > 0))
    counted = new.join(fixed_users, "uid", "left").groupBy("entity", "cohort_month").agg(
        F.count(F.lit(1)).alias("n0"), *[F.count_if(F.col("fixed") & F.col(f"later{k}")).alias(f"n{k}") for k in (1, 2)]
    )
    stages = [
        F.struct(F.lit(name).alias("stage"), F.lit(k + 1).alias("stage_ord"), F.col(f"n{k}").alias("users"), ratio(f"n{k}", "n0").alias("pct"))
        for k, name in enumerate(FUNNEL_STAGES)
    ]
    return counted.select("entity", "cohort_month", F.explode(F.array(*stages)).alias("s")).select("entity", "cohort_month", "s.*").filter("users > 0")


def cohort_layer_funnel_v2(ft: DataFrame, labels: DataFrame, pm: DataFrame, p: Params = Params()) -> DataFrame:
    """D36 intent: the pair is FIXED and still active on that entity k months later."""
    new = ft.select("entity", F.col("month").alias("cohort_month"), "uid")
    fixed_pairs = labels.filter(F.col("label") == FIXED).select("uid", "entity")
    base = new.groupBy("entity", "cohort_month").agg(F.count(F.lit(1)).alias("users"))
    out = base.select(
        "entity", "cohort_month", F.lit(FUNNEL_STAGES[0]).alias("stage"), F.lit(1).alias("stage_ord"),
        "users", F.lit(1.0).alias("pct"),
    )
    for k in (1, 2):
        later = pm.select("uid", "entity", add_periods("month", -k, p.grain).alias("cohort_month"))
        stage = new.join(fixed_pairs, ["uid", "entity"], "left_semi").join(
            later, ["uid", "entity", "cohort_month"], "left_semi"
        )
        out = out.unionByName(_stage(stage, base, k))
    return out
