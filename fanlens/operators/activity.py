"""Active-user layers, penetration and daily event types.

``monthly_active`` is already unique per (month, entity, uid), so every
"COUNT(DISTINCT uid)" over it is a plain (conditional) count — no Expand plan.
Per-month totals that the reference takes as windows over a low-cardinality
key (month) are done as aggregate + join instead, so no single task has to
hold all entities of a month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanlens.functions.math import ratio
from fanlens.params import FIXED, FLOWING, ROAMING, Params


def monthly_active(pm: DataFrame) -> DataFrame:
    """Distinct (month, entity, uid) for real entities (> 0)."""
    return pm.filter(F.col("entity") > 0).select("month", "entity", "uid")


def _layers(label: str = "global_label"):
    g = F.col(label)
    return [
        F.count(F.lit(1)).alias("mau"),
        F.count_if(g == FIXED).alias("fixed_mau"),
        F.count_if(g == FLOWING).alias("flowing_mau"),
        F.count_if(g == ROAMING).alias("roaming_mau"),
    ]


def active_layers(ma: DataFrame, modal: DataFrame) -> DataFrame:
    """Site-wide mau and its split by modal label, per month."""
    users = ma.select("month", "uid").distinct()
    return users.join(modal, "uid").groupBy("month").agg(*_layers())


def entity_active_layers(ma: DataFrame, modal: DataFrame) -> DataFrame:
    """The same per (month, entity)."""
    return ma.join(modal, "uid").groupBy("month", "entity").agg(*_layers())


def penetration(ma: DataFrame) -> DataFrame:
    """Entity mau over distinct site mau, and its change to the previous observed month."""
    anchor = ma.groupBy("month", "entity").agg(F.count(F.lit(1)).alias("mau"))
    industry = ma.select("month", "uid").distinct().groupBy("month").agg(F.count(F.lit(1)).alias("industry_mau"))
    pen = ratio("mau", "industry_mau")
    prev = F.lag(pen).over(Window.partitionBy("entity").orderBy("month"))
    return anchor.join(industry, "month").select(
        "month", "entity", "mau", "industry_mau", pen.alias("penetration"), (pen - prev).alias("pct_change")
    )


def active_layers_totals(eal: DataFrame) -> DataFrame:
    """D30 plus per-month sums over entities (users counted once per entity)."""
    totals = eal.groupBy("month").agg(
        F.sum("mau").alias("industry_mau"),
        F.sum("fixed_mau").alias("industry_fixed"),
        F.sum("flowing_mau").alias("industry_flowing"),
        F.sum("roaming_mau").alias("industry_roaming"),
    )
    return eal.join(totals, "month").select(
        "month", "entity", "mau", "fixed_mau", "flowing_mau", "roaming_mau",
        "industry_mau", "industry_fixed", "industry_flowing", "industry_roaming",
    )


def _types(sentinel: int):
    e = F.col("entity")
    return [
        F.sum(F.when(e == sentinel, F.col("n")).otherwise(0)).alias("weak"),
        F.sum(F.when(e != sentinel, F.col("n")).otherwise(0)).alias("strong"),
        F.sum("n").alias("total"),
    ]


def daily_type(pd_: DataFrame, p: Params = Params()) -> DataFrame:
    """Per day, events on the sentinel (weak) vs real entities (strong)."""
    return pd_.groupBy("day").agg(*_types(p.sentinel))


def entity_daily_type(pd_: DataFrame, p: Params = Params()) -> DataFrame:
    """Per (day, entity) for real entities (weak is always 0 there)."""
    return pd_.filter(F.col("entity") > 0).groupBy("day", "entity").agg(*_types(p.sentinel))
