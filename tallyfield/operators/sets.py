"""Set comparison and deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def presence(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """For each key in any set, whether it is in each one, and whether they differ."""
    tagged = reduce(DataFrame.unionByName, [df.select(key, F.lit(name).alias("tag")) for name, df in sets.items()])
    found = tagged.groupBy(key).agg(*[F.bool_or(F.col("tag") == name).alias(f"in_{name}") for name in sets])
    same = reduce(lambda a, b: a & b, [F.col(f"in_{a}") == F.col(f"in_{b}") for a, b in zip(list(sets), list(sets)[1:], strict=False)])
    return found.withColumn("mismatch", ~same)


def case_insensitive_first(df: DataFrame, word: str, place: str, most: int) -> DataFrame:
    """The first form of each word without regard to case, in order of first place, up to `most`."""
    first = df.groupBy(F.lower(word).alias("word")).agg(F.min_by(word, place).alias("first_form"), F.min(place).alias("place"))
    return first.orderBy("place").limit(most)
