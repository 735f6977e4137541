"""Ordered operators within a key: latest and top rows, runs, running frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], *order, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_key(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The first n rows of each key; Spark drops the others before the shuffle."""
    return numbered(df, keys, *order, name="__rn").filter(F.col("__rn") <= n).drop("__rn")


def latest_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row of each key, the greatest by the columns order, as a map-side aggregate; order should end in a unique column."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("__best"))
    return best.select("__best.*")


def islands(df: DataFrame, keys: list[str], order: list, changed: Column, name: str = "island") -> DataFrame:
    """Number the runs of each key from 1; changed, given over the same window, is true where a run begins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(changed, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def change_rows(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Rows whose value differs from their predecessor's: consecutive repeats collapse to the first."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    return df.withColumn("__keep", first | before.isNull() | ~before.eqNullSafe(F.col(value))).filter("__keep").drop("__keep")


def uncovered(df: DataFrame, keys: list[str], start: str, end: str, *tie) -> DataFrame:
    """Drop intervals that lie wholly inside what earlier ones covered: start before and end not after the running maximum end."""
    w = Window.partitionBy(*keys).orderBy(start, *tie).rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max(end).over(w)
    return df.withColumn("__inside", (F.col(start) < covered) & (F.col(end) <= covered)).filter(~F.coalesce("__inside", F.lit(False))).drop("__inside")


def offsets(df: DataFrame, keys: list[str], order: list, text: str, name: str = "char_start") -> DataFrame:
    """Character offset of each row's text, if the texts of a key are joined by single characters."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0)))


def new_members(df: DataFrame, keys: list[str], order: list, items: str, back: int, name: str = "new_items") -> DataFrame:
    """Items of a row's array that none of the `back` rows before it had."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-back, -1)
    return df.withColumn(name, F.array_except(items, F.flatten(F.collect_list(items).over(w))))


def local_maxima(df: DataFrame, keys: list[str], order: list, value: str, reach: int, least: float) -> DataFrame:
    """Rows whose value is at least `least` and the greatest within `reach` rows on either side."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach)
    return df.withColumn("__top", F.max(value).over(w)).filter((F.col(value) == F.col("__top")) & (F.col(value) >= least)).drop("__top")
