"""Work queues without row locks: every waiting row belongs to one worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def owner(key: Column, workers: int) -> Column:
    """The one worker of a key, from the digest of its text, so that any process can tell; a null key is the first one's."""
    digest = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.coalesce(F.pmod(digest, F.lit(workers).cast("long")), F.lit(0).cast("long"))


def claims(waiting: DataFrame, key: str, order: list[str], workers: int, limit: int) -> DataFrame:
    """The first `limit` waiting rows of each worker, with worker and place from 1, by order and then key.

    No row is with two workers, and what one leaves waiting stays its own, so workers need no lock. Each task keeps the first `limit` rows of a worker before they are dealt out.
    """
    owned = waiting.withColumn("worker", owner(F.col(key), workers))
    place = F.row_number().over(Window.partitionBy("worker").orderBy(*order, key))
    return owned.withColumn("place", place.cast("long")).filter(F.col("place") <= limit)


def claim(waiting: DataFrame, key: str, order: list[str], workers: int, worker: int, limit: int) -> DataFrame:
    """What one worker takes now: its first `limit` waiting rows in order; the others are never sorted in one place."""
    return waiting.filter(owner(F.col(key), workers) == worker).orderBy(*order, key).limit(limit)


def finished(queue: DataFrame, done: DataFrame, key: str, status: str, value) -> DataFrame:
    """The queue after some claimed rows are done: their status is value."""
    marked = done.select(key, F.lit(True).alias("__done")).distinct()
    return queue.join(marked, key, "left").withColumn(status, F.when(F.col("__done"), F.lit(value)).otherwise(F.col(status))).drop("__done")
