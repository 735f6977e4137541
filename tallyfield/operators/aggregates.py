"""Aggregations with fixed columns, ties and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_sum(c) -> Column:
    """Sum of a double with two decimals, exact whatever the order of rows."""
    return F.sum(F.col(c).cast("decimal(18,2)") if isinstance(c, str) else c.cast("decimal(18,2)")).cast("double")


def exact_avg(c) -> Column:
    return exact_sum(c) / F.count(c)


def pivot_counts(df: DataFrame, keys: list[str], category: str, names: list[str]) -> DataFrame:
    """Counts of each named category per key, in one pass; a key with other categories only has zeros."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(category) == n).alias(f"n_{n.lower().lstrip('0123456789-').replace(' ', '_')}") for n in names])


def mode_share(df: DataFrame, keys: list[str], value: str, *tie) -> DataFrame:
    """The most frequent value of each key, its count and its share; ties by the aggregate columns `tie`, given as (name, aggregate), then value."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), *[a.alias(n) for n, a in tie])
    total = Window.partitionBy(*keys)
    order = total.orderBy(F.desc("n"), *[n for n, _ in tie], value)
    ranked = counted.withColumn("total", F.sum("n").over(total)).withColumn("__rn", F.row_number().over(order))
    return ranked.filter("__rn = 1").select(*keys, value, "n", (F.col("n") / F.col("total")).alias("share"))


def histogram(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """A map from value to count per key, its keys in order."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias(name))


def ordered_text(df: DataFrame, keys: list[str], order: str, text: str, name: str, sep: str = " ") -> DataFrame:
    """The texts of a key joined in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text])
    return df.groupBy(*keys).agg(F.concat_ws(sep, parts).alias(name))
