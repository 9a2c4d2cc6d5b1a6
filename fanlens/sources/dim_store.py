"""Dimensions as stored tables with upsert (I09, D01, D23): ``INSERT OR REPLACE`` by key.

The table is cut into buckets by a hash of its key, one folder each.  An upsert reads
the buckets its keys fall in, drops updates that say what is stored already, and
writes again only the buckets of what is left (staged, then swapped).  A repeat
changes nothing, and other buckets keep their files.  The number of buckets belongs
to the table: open it with the same number each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanlens.session import ensure_checkpoint_dir
from fanlens.sources import dims, partitions

BUCKETS = 64


class StoredDim:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = schema
        self._stored = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])

    def _rows(self) -> DataFrame:
        return partitions.read_or_empty(self.spark, self.path, self._stored)

    def read(self) -> DataFrame:
        """The table as of the last upsert."""
        return self._rows().select(*self.schema.names)

    def upsert(self, updates: DataFrame, order: str) -> int:
        """Rows of ``updates`` replace rows of the table by key; returns how many keys changed.

        ``order``: a column of ``updates`` that says which of several rows of a key came last.
        A null key is a key like others."""
        ensure_checkpoint_dir(self.spark)
        partitions.finish(self.spark, self.path, self._stored, "bucket")
        names = self.schema.names
        last = F.row_number().over(Window.partitionBy(self.key).orderBy(F.col(order).desc(), *[F.col(c).desc() for c in names]))
        new = updates.withColumn("_last", last).where("_last = 1").select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        new = new.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        stored = self._rows()
        near = stored.where(F.col("bucket").isin(self._touched(new)))
        changed = new.join(near, [new[c].eqNullSafe(near[c]) for c in [*names, "bucket"]], "left_anti").withColumn("order", F.lit(0)).checkpoint()
        n = changed.count()
        if n:
            old = stored.where(F.col("bucket").isin(self._touched(changed)))
            partitions.replace_partitions(dims.upsert(old, changed, self.key, "order").select(*names, "bucket"), self.path, "bucket")
        return n

    @staticmethod
    def _touched(rows: DataFrame) -> list[int]:
        return [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most the table's buckets


def entity_dim(spark: SparkSession, path: str, buckets: int = BUCKETS) -> StoredDim:
    """D01 as a stored table."""
    return StoredDim(spark, path, dims.ENTITY_SCHEMA, "entity", buckets)


def segment_dim(spark: SparkSession, path: str) -> StoredDim:
    """D23 as a stored table: three rows, one bucket."""
    return StoredDim(spark, path, dims.SEGMENT_SCHEMA, "label", 1)
