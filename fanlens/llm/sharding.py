"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked there; the
fractional rank (rank + 1/2) / source size spreads every source evenly over
(0, 1).  All rows sorted by fractional rank are cut into shards of equal row
counts, so each shard has the mixture of the whole.

Neither ranking puts a source, or all rows, into one task: both orders are cut
into hash or rank ranges of about ``bucket_rows`` rows, the ranges' counts give
the offsets, and rows are numbered within their range only.

Defined cases: a null source is a source of its own, a null key is shuffled as
an empty string.  Rows with the same key are ordered by the hash of all their
columns; wholly equal rows are interchangeable.  Empty input gives an empty
result.  Input columns keep their names; ``shard`` and ``slot`` replace columns
of those names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = "7"


def interleave(df: DataFrame, shards: int, key: str = "doc_id", source: str = "source", seed: str = SEED, bucket_rows: int = 50_000) -> DataFrame:
    """``df`` with ``shard`` (int, 0 to shards - 1) and ``slot`` (long, gapless from 0 in a shard).

    Law ``rows``: the shards' row counts differ by at most one."""
    n = df.count()
    buckets = max(1, -(-n // bucket_rows))
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    stratum = F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string")))
    mixed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    tie = F.xxhash64(*[F.col(c) for c in kept])
    rows = df.select(F.struct(*kept).alias("row"), stratum.alias("s"), mixed.alias("h"), tie.alias("t"))
    lead = F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumn("b", F.floor(lead * buckets / F.lit(float(1 << 32))))

    counts = rows.groupBy("s", "b").agg(F.count("*").alias("c"))
    of_source = Window.partitionBy("s")
    offsets = counts.select(
        "s", "b",
        (F.sum("c").over(of_source.orderBy("b")) - F.col("c")).alias("before"),
        F.sum("c").over(of_source).alias("size"),
    )
    local = F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "t"))
    ranked = rows.withColumn("n", local).join(offsets, ["s", "b"])
    fraction = (F.col("before") + F.col("n") - F.lit(0.5)) / F.col("size")
    ranked = ranked.select("row", "h", "t", fraction.alias("f")).withColumn("g", F.floor(F.col("f") * buckets))

    ahead = ranked.groupBy("g").agg(F.count("*").alias("c"))
    ahead = ahead.select("g", (F.sum("c").over(Window.orderBy("g")) - F.col("c")).alias("before"))  # one row a range
    local = F.row_number().over(Window.partitionBy("g").orderBy("f", "h", "t"))
    placed = ranked.withColumn("n", local).join(ahead, "g").withColumn("pos", F.col("before") + F.col("n") - 1)
    placed = placed.withColumn("shard", F.expr(f"cast(pos * {shards} div {max(n, 1)} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")
    return placed.select("row.*", "shard", (F.col("pos") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order within each file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
