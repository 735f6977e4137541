"""Stored tables dealt by key, so that a change neither shuffles nor rewrites what it doesn't touch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.session import fresh_path

SLICE = "__slice"


class KeyedTable:
    """A Parquet table in the catalog, cut into slices (folders) by a hash of the key and bucketed by key in each.

    A change reads the slices that its keys fall in. There the old side of a join by key is read in its buckets as it lies, without an exchange; the new rows
    go to it. Only these slices are replaced, one after another as a job of Spark's dynamic partition overwrite; all other files stay. A change whose job fails leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, name: str, keys: list[str], slices: int, buckets: int):
        self.spark, self.name, self.keys, self.slices, self.buckets = spark, name, keys, slices, buckets

    @classmethod
    def create(cls, df: DataFrame, keys: list[str], slices: int = 16, buckets: int | None = None, path: str | None = None) -> KeyedTable:
        """A new table with df's rows. With as many buckets as shuffle partitions, the default, joins need no exchange on its side."""
        spark = df.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = cls(spark, f"keyed_{uuid.uuid4().hex}", keys, slices, buckets)
        dealt = df.withColumn(SLICE, table.slice()).repartition(buckets, *keys)
        dealt.write.format("parquet").partitionBy(SLICE).bucketBy(buckets, *keys).sortBy(*keys).option("path", path or fresh_path(spark, "keyed")).saveAsTable(table.name)
        return table

    def slice(self) -> Column:
        # another hash than that of buckets, so that a slice has rows of all of them
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.slices)).cast("int")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop(SLICE)

    def touched(self, new: DataFrame) -> list[int]:
        """The slices that keys of new rows fall in: no more numbers than slices."""
        return sorted(r[0] for r in new.select(self.slice()).distinct().collect())

    def part(self, slices: list[int]) -> DataFrame:
        return self.spark.table(self.name).filter(F.col(SLICE).isin(slices)).drop(SLICE)

    def change(self, new: DataFrame, state: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace each touched slice by state(its rows, new rows), which keeps all keys and columns; gives the slices."""
        slices = self.touched(new)
        if not slices:
            return []
        columns = [c for c in self.spark.table(self.name).columns if c != SLICE]
        out = state(self.part(slices), new).select(*columns).withColumn(SLICE, self.slice()).repartition(self.buckets, *self.keys)
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            out.write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set(mode, before)
        self.spark.catalog.refreshTable(self.name)
        return slices

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
