"""Net churn of the flowing layer (D32 site-wide, D41 per entity).

in  = first touches whose source is the roaming sentinel,
out = first touches whose target is the roaming sentinel,
net_flow = in - out, churn_rate = -net / flowing_mau (null when 0).
Months missing from the layer table drop out (full join, then inner join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanlens.functions.math import safe_ratio
from fanlens.params import Params


def _flow(mi: DataFrame, mo: DataFrame, on: list[str], sentinel: int) -> DataFrame:
    inflow = mi.groupBy(*on).agg(F.sum(F.when(F.col("source") == sentinel, F.col("cnt")).otherwise(0)).alias("in_roaming"))
    outflow = mo.groupBy(*on).agg(F.sum(F.when(F.col("target") == sentinel, F.col("cnt")).otherwise(0)).alias("out_roaming"))
    return inflow.join(outflow, on, "full").select(
        *on,
        F.coalesce("in_roaming", F.lit(0).cast("bigint")).alias("in_roaming"),
        F.coalesce("out_roaming", F.lit(0).cast("bigint")).alias("out_roaming"),
    )


def flow_net_churn(mi: DataFrame, mo: DataFrame, layers: DataFrame, p: Params = Params()) -> DataFrame:
    """(month, net_flow, net_rate, churn_rate)."""
    flow = _flow(mi, mo, ["month"], p.sentinel)
    net = F.col("in_roaming") - F.col("out_roaming")
    return flow.join(layers.select("month", "flowing_mau"), "month").select(
        "month",
        net.alias("net_flow"),
        safe_ratio(net, "flowing_mau").alias("net_rate"),
        safe_ratio(-net, "flowing_mau").alias("churn_rate"),
    )


def entity_flow_net_churn(mi: DataFrame, mo: DataFrame, eal: DataFrame, p: Params = Params()) -> DataFrame:
    """(entity, month, net_flow, churn_rate) for real entities."""
    mi_ = mi.filter(F.col("target") > 0).withColumnRenamed("target", "entity")
    mo_ = mo.filter(F.col("source") > 0).withColumnRenamed("source", "entity")
    flow = _flow(mi_, mo_, ["entity", "month"], p.sentinel)
    net = F.col("in_roaming") - F.col("out_roaming")
    return flow.join(eal.select("entity", "month", "flowing_mau"), ["entity", "month"]).select(
        "entity", "month", net.alias("net_flow"), safe_ratio(-net, "flowing_mau").alias("churn_rate")
    )
