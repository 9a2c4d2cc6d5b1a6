"""Distinct users as mergeable sets: exact bitmaps, and a sketch (COUNT DISTINCT of D16, D29-D31, A44).

Users get dense numbers from a stored dictionary that only grows.  A set of users is
a list of bitmaps of 32,768 numbers each (``bitmap_construct_agg``), and sets unite
by ``bitmap_or_agg``: over entities, over months, or both.  A count over any range of
months thus reads stored bitmaps and never shuffles (month, uid) again.

A set is built where its rows meet: the numbers are shuffled by group and bucket, so
each bitmap is made once, by one task, from at most 32,768 users.  (Bitmaps begun by
each task for its own rows would be as many as tasks times sets, 4 KB each.)

``HyperLogLog`` sketches (``sketches``) take a bounded size for any number of users and
give estimates; ``lg_k`` sets their size and error (about 1.04 / sqrt(2 ** lg_k)).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanlens.params import FIXED, FLOWING, ROAMING
from fanlens.session import ensure_checkpoint_dir
from fanlens.sources import partitions

DICT_SCHEMA = T.StructType([T.StructField("uid", T.LongType()), T.StructField("number", T.LongType()), T.StructField("part", T.LongType())])
BITMAP_SCHEMA = T.StructType(
    [T.StructField("entity", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("month", T.TimestampNTZType())]
)
HASH_RANGES = 256  # a power of two
LG_K = 12


def numbered(users: DataFrame, first: int = 0, hash_ranges: int = HASH_RANGES) -> DataFrame:
    """Distinct non-null ``uid`` -> number from ``first`` on, by ranges of hashes: a range's users are numbered in a row."""
    part = F.shiftrightunsigned(F.xxhash64("uid"), 65 - hash_ranges.bit_length())
    rows = users.where("uid IS NOT NULL").select("uid").distinct().withColumn("part", part)
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # a row a range
    own = F.row_number().over(Window.partitionBy("part").orderBy("uid"))
    return rows.withColumn("own", own).join(F.broadcast(before), "part").select(
        "uid", (F.col("before") + F.col("own") - 1 + first).alias("number"), "part"
    )


def user_sets(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: ``by`` columns and number.  ``by``, bucket, bits: the set of numbers of each group."""
    bucket, bit = F.bitmap_bucket_number("number"), F.bitmap_bit_position("number")
    met = rows.select(*by, bucket.alias("bucket"), bit.alias("bit")).repartition(*by, "bucket")  # few bytes a row, one task a bitmap
    return met.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def united(sets: DataFrame, by: list[str]) -> DataFrame:
    """The union of the sets of each group of ``by``."""
    return sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(sets: DataFrame, by: list[str], name: str = "users") -> DataFrame:
    """Members of each group's union."""
    return united(sets, by).groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(name))


def layers(sets: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """Members of each group's union with a label, and those of each label.

    sets: ``by``, bucket, bits (one row each); labels: label, bucket, bits, every user in
    one label's set.  Groups and labels meet by bucket and are cut by ``bitmap_and_agg``."""
    marks = labels.select("bucket", "label", F.col("bits").alias("of_label"))
    both = sets.join(marks, "bucket").select(*by, "bucket", "label", F.explode(F.array("bits", "of_label")).alias("bits"))
    both = both.groupBy(*by, "bucket", "label").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("users"))
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("users")).otherwise(0))
    out = both.groupBy(*by).agg(F.sum("users").alias("mau"), of(FIXED).alias("fixed_mau"), of(FLOWING).alias("flowing_mau"), of(ROAMING).alias("roaming_mau"))
    return out.where("mau > 0")


def month_range(sets: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The stored months from ``first`` to ``last`` (both included)."""
    keep: Column = F.lit(True)
    if first is not None:
        keep = keep & (F.col("month") >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        keep = keep & (F.col("month") <= F.lit(last).cast("timestamp_ntz"))
    return sets.where(keep)


def sketches(rows: DataFrame, by: list[str], lg_k: int = LG_K) -> DataFrame:
    """``by``, sketch: a HyperLogLog sketch of each group's users."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg("uid", F.lit(lg_k)).alias("sketch"))


def estimated(kept: DataFrame, by: list[str], name: str = "users") -> DataFrame:
    """Estimated members of each group's union of sketches."""
    return kept.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))


class UserBitmaps:
    """Stored: a dictionary of users, and for each month and entity the set of its users."""

    def __init__(self, spark: SparkSession, path: str, hash_ranges: int = HASH_RANGES):
        self.spark, self.hash_ranges = spark, hash_ranges
        self.dict_path, self.sets_path = os.path.join(path, "users"), os.path.join(path, "user_sets")

    def dictionary(self) -> DataFrame:
        return partitions.read_or_empty(self.spark, self.dict_path, DICT_SCHEMA)

    def sets(self) -> DataFrame:
        """month, entity, bucket, bits (entities of any kind, the sentinel included)."""
        return partitions.read_or_empty(self.spark, self.sets_path, BITMAP_SCHEMA)

    def label_sets(self, labels: DataFrame) -> DataFrame:
        """label, bucket, bits: the users of each modal label."""
        rows = labels.join(self.dictionary().select("uid", "number"), "uid")
        return user_sets(rows.select(F.col("global_label").alias("label"), "number"), ["label"])

    def replace(self, pair_months: DataFrame) -> None:
        """Set the months of ``pair_months`` (all its rows of them) anew; unknown users are added to the dictionary."""
        partitions.finish(self.spark, self.sets_path, BITMAP_SCHEMA, "month")
        partitions.finish(self.spark, self.dict_path, DICT_SCHEMA, "part")
        users = pair_months.select("uid").distinct()
        known = self.dictionary()
        size = known.agg(F.coalesce(F.max("number") + 1, F.lit(0)).alias("n")).first()["n"]
        fresh = users.join(known, "uid", "left_anti")
        # the whole dictionary of a touched hash range is written again: a cut-off job leaves no half of a range
        ensure_checkpoint_dir(self.spark)
        new = numbered(fresh, size, self.hash_ranges).checkpoint()
        if not new.isEmpty():
            touched = new.select("part").distinct()
            old = known.join(F.broadcast(touched), "part", "left_semi")  # at most a row a range
            partitions.replace_partitions(old.select("uid", "number", "part").unionByName(new), self.dict_path, "part")
        rows = pair_months.join(self.dictionary().select("uid", "number"), "uid")
        sets = user_sets(rows.select("month", "entity", "number"), ["month", "entity"])
        partitions.replace_partitions(sets.select("entity", "bucket", "bits", "month"), self.sets_path, "month")
