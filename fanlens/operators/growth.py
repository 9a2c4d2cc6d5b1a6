"""Growth curves and lifecycle stages.

D34/D35 use the initial guesses (K = 1.2·max, r = 0.35, t0 = n/2), not a fit —
that is the behaviour reproduced.  The least-squares fit lives in
``fanlens.operators.curvefit`` (A10-A15).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanlens.functions.math import logistic_slope
from fanlens.params import STAGES, Params


def growth_sequence(eal: DataFrame) -> DataFrame:
    """0-based ordinal of each observed month per entity (gaps not filled)."""
    seq = F.row_number().over(Window.partitionBy("entity").orderBy("month")) - 1
    return eal.select("entity", "month", "mau", seq.cast("bigint").alias("seq"))


def cumulative_acquisitions(acq: DataFrame) -> DataFrame:
    """Users met so far by month, as a growth sequence: a series that only grows towards a ceiling."""
    w = Window.partitionBy("entity").orderBy("month")
    return acq.select(
        "entity", "month", F.sum("acq").over(w).alias("mau"), (F.row_number().over(w) - 1).cast("bigint").alias("seq")
    )


def growth_params_init(seq: DataFrame, p: Params = Params()) -> DataFrame:
    """Per entity with >= min_points months of mau > 0."""
    return (
        seq.filter(F.col("seq").isNotNull() & (F.col("mau") > 0))
        .groupBy("entity")
        .agg(F.max("mau").alias("mx"), F.count(F.lit(1)).alias("cnt"))
        .filter(F.col("cnt") >= p.growth_min_points)
        .select(
            "entity",
            (F.col("mx").cast("double") * F.lit(p.growth_k_factor)).alias("K"),
            F.lit(p.growth_r_init).alias("r"),
            (F.col("cnt").cast("double") * F.lit(p.growth_t0_factor)).alias("t0"),
        )
    )


def stage_of(seq, t0):
    """Six lifecycle stages by position relative to t0; inclusive bands, first match wins."""
    s, t = F.col(seq), F.col(t0)
    return (
        F.when(s < t - 2, STAGES[0])
        .when(s.between(t - 2, t + 2), STAGES[1])
        .when(s.between(t + 2, t + 6), STAGES[2])
        .when(s.between(t + 6, t + 10), STAGES[3])
        .when(s.between(t + 10, t + 14), STAGES[4])
        .otherwise(STAGES[5])
    )


def lifecycle_stage(seq: DataFrame, params: DataFrame) -> DataFrame:
    """Logistic slope at each point and the stage."""
    return seq.join(params, "entity").select(
        "entity", "month", "mau", "seq", "K", "r", "t0",
        logistic_slope(F.col("seq"), F.col("K"), F.col("r"), F.col("t0")).alias("deriv"),
        stage_of("seq", "t0").alias("stage"),
    )
