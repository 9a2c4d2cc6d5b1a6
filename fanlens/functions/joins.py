"""Joins of many rows with one row an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_BYTES = 128  # at least what a row of per-entity numbers takes
SALTS = 64


def join_per_entity(rows: DataFrame, per_entity: DataFrame, spread: str = "uid") -> DataFrame:
    """``rows`` with its entity's row of ``per_entity`` (which the caller has kept).

    The small side is counted, then broadcast if it fits the session's broadcast
    threshold, so ``rows`` is not shuffled; else every entity is dealt over ``SALTS``
    keys by ``spread``, so an entity with a third of all rows is many tasks."""
    spark = rows.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if per_entity.count() * ROW_BYTES <= limit:
        return rows.join(F.broadcast(per_entity), "entity")
    salted = per_entity.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return rows.join(salted, ["entity", "salt"]).drop("salt")


def free_names(df: DataFrame, names: list[str]) -> list[str]:
    """``names``, each with underscores behind it until no column of ``df`` begins so."""
    taken = [c.lower() for c in df.columns]
    out = []
    for name in names:
        while any(c.startswith(name.lower()) for c in taken):
            name += "_"
        out.append(name)
    return out
