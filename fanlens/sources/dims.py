"""Dimensions: entity names (D01) and audience segments (D23), with PK upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanlens.params import SEGMENT_NAMES
from fanlens.sources.interactions import table

ENTITY_SCHEMA = T.StructType([T.StructField("entity", T.LongType()), T.StructField("name", T.StringType())])
SEGMENT_SCHEMA = T.StructType([T.StructField("label", T.LongType()), T.StructField("name", T.StringType())])


def upsert(base: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """I09 ``INSERT OR REPLACE``: rows of ``updates`` replace rows of ``base`` by key.

    ``order``: a column of ``updates`` (not of ``base``) that says which of several
    rows of a key came last; that row wins."""
    tagged = base.withColumn("_src", F.lit(0)).withColumn("_pos", F.lit(0).cast("bigint")).unionByName(
        updates.withColumn("_src", F.lit(1)).withColumn("_pos", F.col(order).cast("bigint")).drop(order)
    )
    w = Window.partitionBy(key).orderBy(F.col("_src").desc(), F.col("_pos").desc())
    return tagged.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_src", "_pos", "_rn")


def entity_dim_from_rows(spark: SparkSession, rows) -> DataFrame:
    """I08 VALUES source + PK upsert into an empty dim."""
    return _from_values(spark, rows, ENTITY_SCHEMA, "entity")


def _from_values(spark: SparkSession, rows, schema: T.StructType, key: str) -> DataFrame:
    numbered = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], T.StructType([*schema.fields, T.StructField("pos", T.LongType())]))
    return upsert(spark.createDataFrame([], schema), numbered, key, "pos")


def nation_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity = n_nationkey + 1, name = n_name."""
    rows = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 1).cast("bigint").alias("entity"), F.col("n_name").alias("name"), "n_nationkey"
    )
    return upsert(spark.createDataFrame([], ENTITY_SCHEMA), rows, "entity", "n_nationkey")


def segment_dim(spark: SparkSession) -> DataFrame:
    """Label -> segment name."""
    return _from_values(spark, sorted(SEGMENT_NAMES.items()), SEGMENT_SCHEMA, "label")


def assert_unique(df: DataFrame, key: str) -> None:
    """Primary keys are not enforced by Spark, check them explicitly."""
    dup = df.groupBy(key).count().filter("count > 1").limit(1).count()
    if dup:
        raise ValueError(f"duplicate primary key values in column {key!r}")
