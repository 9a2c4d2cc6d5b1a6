"""The interaction log and the fixtures that derive it from the test tables.

Contract: ``uid`` long, ``entity`` long (real entities > 0, the roaming
sentinel -3 allowed), ``ts`` timestamp_ntz.  The log is a bag: duplicates count.

Fixtures (see FIXTURES.md):

* F1 ``orders ⋈ lineitem ⋈ supplier``: uid = o_custkey, entity = s_nationkey + 1,
  ts = o_orderdate (one row per line item, 80 months).
* F2 F1 with nation 24 mapped to the sentinel -3 (weak events).
* F3 ``events``: uid = user_id, entity = 1..5 by sorted event_type (sub-day times).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanlens.params import ROAMING

INTERACTION_SCHEMA = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("entity", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)

# sorted event types of the ``events`` table -> entity id (fixed values)
EVENT_TYPE_ENTITY = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}

SENTINEL_NATION = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def conform(df: DataFrame) -> DataFrame:
    """Project any (uid, entity, ts) frame onto the log contract."""
    return df.select(
        F.col("uid").cast("bigint").alias("uid"),
        F.col("entity").cast("bigint").alias("entity"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
    )


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet interaction log.

    A ``month`` partition column (as written by the ingestion jobs) is kept so
    that time filters can also prune partitions."""
    raw = spark.read.parquet(path)
    if "month" not in raw.columns:
        return conform(raw)
    return raw.select(
        F.col("uid").cast("bigint").alias("uid"),
        F.col("entity").cast("bigint").alias("entity"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("month").cast("timestamp_ntz").alias("month"),
    )


def _orders_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item with its order and supplier.

    A task hashes its orders, of which there are a few times fewer than lines, and does not
    sort and hold its lines; a hot order may still be split."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        lines.join(orders.hint("shuffle_hash"), lines.l_orderkey == orders.o_orderkey)
        .join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
    )


def orders_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1."""
    df = _orders_lines(spark, sf_dir)
    return conform(
        df.select(
            F.col("o_custkey").alias("uid"),
            (F.col("s_nationkey") + 1).alias("entity"),
            F.col("o_orderdate").alias("ts"),
        )
    )


def orders_interactions_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 with one nation mapped to the roaming sentinel."""
    df = _orders_lines(spark, sf_dir)
    entity = F.when(F.col("s_nationkey") == SENTINEL_NATION, F.lit(ROAMING)).otherwise(F.col("s_nationkey") + 1)
    return conform(df.select(F.col("o_custkey").alias("uid"), entity.alias("entity"), F.col("o_orderdate").alias("ts")))


def events_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the sub-day ``events`` table."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    mapping = F.create_map(*[x for k, v in EVENT_TYPE_ENTITY.items() for x in (F.lit(k), F.lit(v))])
    return conform(ev.select(F.col("user_id").alias("uid"), mapping[F.col("event_type")].alias("entity"), "ts"))


FIXTURES = {
    "f1": orders_interactions,
    "f2": orders_interactions_sentinel,
    "f3": events_interactions,
}
