"""Where users come from and where they go.

For a first touch of entity E in month M by user U:

* source = the entity U had most events with strictly before M (ties -> the
  smallest id), -3 when there is none.  E itself has no event before its own
  first-touch month, so "other than E" holds automatically and the answer only
  depends on (U, M).  Because every entity's running count only grows, the
  leader before M is the running maximum of (count so far, -entity) over U's
  monthly timeline — two window passes over ``pair_months`` partitioned by
  user, no join and no per-(U, M) fan-out.
* target = the entity other than E that U had most events with from M + 1 month
  on (ties -> the smallest id), -3 when there is none.  The answer depends on
  (U, M) through the top-2 list: the first unless it is E, else the second.

The target uses the mirrored running maximum over the *remaining* events
(all less those before, scanned from the latest month back).  Only when that leader is
E itself is the runner-up needed; for those first touches alone (a few percent
on the test data) U's distinct cells after M + 1 month are joined and ranked.
That join is bounded by (#months × #entities) rows per user however many raw
events the user has, and with ``pair_months`` partitioned by user it runs
without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanlens.functions.time import add_periods, period_index
from fanlens.params import Params


def _timeline(ft: DataFrame, pm: DataFrame, forward: bool, grain: str) -> DataFrame:
    """Marks (one per first touch) with the leading entity key before M (forward)
    or from the period after M on (backward)."""
    pair = Window.partitionBy("uid", "entity")
    running = F.sum("n").over(pair.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if not forward:  # what remains, in the same order
        running = F.sum("n").over(pair) - running + F.col("n")
    cells = pm.select(
        "uid",
        period_index("month", grain).alias("mi"),
        F.struct(running.cast("bigint").alias("c"), (-F.col("entity")).alias("ne")).alias("key"),
        F.lit(None).cast("bigint").alias("x"),
        F.lit(None).cast("timestamp_ntz").alias("month"),
    )
    marks = ft.select(
        "uid",
        period_index("month", grain).alias("mi"),
        F.lit(None).cast("struct<c:bigint,ne:bigint>").alias("key"),
        F.col("entity").alias("x"),
        "month",
    )
    mi = F.col("mi") if forward else F.col("mi").desc()
    leader = F.max("key").over(Window.partitionBy("uid").orderBy(mi).rangeBetween(Window.unboundedPreceding, -1))
    return (
        cells.unionByName(marks)
        .withColumn("leader", leader)
        .filter(F.col("x").isNotNull())
        .select("uid", "x", "month", (-F.col("leader.ne")).alias("leader"))
    )


def flow_source(ft: DataFrame, pm: DataFrame, p: Params = Params()) -> DataFrame:
    """(uid, target, month, source)."""
    return _timeline(ft, pm, True, p.grain).select(
        "uid",
        F.col("x").alias("target"),
        "month",
        F.coalesce("leader", F.lit(p.sentinel).cast("bigint")).alias("source"),
    )


def flow_target(ft: DataFrame, pm: DataFrame, p: Params = Params()) -> DataFrame:
    """(uid, source, month, target)."""
    marks = _timeline(ft, pm, False, p.grain)
    cells = pm.select(F.col("uid").alias("user"), F.col("entity").alias("other"), F.col("month").alias("at"), "n")
    rest = (F.col("leader") == F.col("x")) & (F.col("at") >= add_periods("month", 1, p.grain)) & (F.col("other") != F.col("x"))
    # a mark keeps its row whether or not it needs a runner-up, so the timelines are built once
    met = (
        marks.join(cells, (F.col("uid") == F.col("user")) & rest, "left")
        .groupBy("uid", "x", "month", "leader", "other")
        .agg(F.sum("n").alias("cnt"))
        .groupBy("uid", "x", "month")
        .agg(F.max("leader").alias("leader"), (-F.max(F.struct("cnt", (-F.col("other")).alias("ne")))["ne"]).alias("second"))
    )
    pick = F.when(F.col("leader") != F.col("x"), F.col("leader")).otherwise(F.col("second"))
    return met.select(
        "uid",
        F.col("x").alias("source"),
        "month",
        F.coalesce(pick, F.lit(p.sentinel).cast("bigint")).alias("target"),
    )


def flow_matrix_in(fs: DataFrame) -> DataFrame:
    """First touches per (target, month, source)."""
    return fs.groupBy("target", "month", "source").agg(F.count(F.lit(1)).alias("cnt"))


def flow_matrix_out(ft_: DataFrame) -> DataFrame:
    """First touches per (source, month, target)."""
    return ft_.groupBy("source", "month", "target").agg(F.count(F.lit(1)).alias("cnt"))
