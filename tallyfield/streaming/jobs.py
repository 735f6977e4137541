"""Structured Streaming forms of the incremental operators, over file sources with availableNow."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyfield.session import fresh_path

#: Keeps state on the executors' disks, outside the heap, with a change log in the checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(df: DataFrame, spark: SparkSession) -> DataFrame:
    """df's rows as a file stream: written once to shared storage, then read as a stream."""
    path = fresh_path(spark, "source")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def run(rows: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that is there now, processed with a checkpoint beside the output, which is then read; a rerun goes on where it stopped."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if mode == "append":
        query = rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    else:
        def write(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out")

        query = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


def first_of_key(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key, ever: state grows with the keys; use first_of_key_within where late repeats have a bound."""
    return rows.dropDuplicates([key])


def first_of_key_within(rows: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def tumbling(rows: DataFrame, ts: str, width: str, keys: list[str]) -> DataFrame:
    grouped = rows.groupBy(F.window(ts, width).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(rows: DataFrame, ts: str, gap: str, keys: list[str], delay: str) -> DataFrame:
    """Runs of rows of a key without a gap, given out once the watermark has passed their end."""
    grouped = rows.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


class LastValue(StatefulProcessor):
    """Rows whose value is not the last one of their key; the state is that value and its time, and goes once its key has been idle."""

    def __init__(self, key: str, ts: str, value: str, value_type: str, idle_ms: int):
        self.names, self.kind, self.idle = (key, ts, value), value_type, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"value {self.kind}, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, ts, value = self.names
        got = pd.concat(list(rows), ignore_index=True).sort_values(ts, kind="stable")
        at, values = got[ts].astype("datetime64[us]").astype("int64").to_numpy(), got[value].tolist()
        known = self.last.get() if self.last.exists() else None
        before, before_at = known if known else (None, None)
        kept = []
        for k, (when, now) in enumerate(zip(at.tolist(), values, strict=True)):
            now = None if pd.isna(now) else now
            if before_at is not None and when < before_at:
                continue  # older than what is known
            if before_at is None or before is None or now != before or when - before_at > self.idle * 1000:
                kept.append(k)
            before, before_at = now, when
        self.last.update((before, before_at))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(before_at // 1000 + self.idle + 1)
        yield got.iloc[kept][list(self.names)]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame(columns=list(self.names))

    def close(self) -> None:
        pass


def milliseconds(span: str) -> int:
    return int(pd.Timedelta(span) / datetime.timedelta(milliseconds=1))


def changes(rows: DataFrame, key: str, ts: str, value: str, delay: str = "1 day", idle: str = "365 days") -> DataFrame:
    """Rows whose value differs from the last one of their key, or that come over `idle` after it; a null is a value that nothing equals.

    State: one value and its time for each key that has had a row within `idle` and `delay` of the newest row: a timer clears it once the watermark is past that, and no row
    that may still come would have been held back by it. Rows older than the watermark, or than the last row of their key in an earlier trigger, are late and are dropped.
    Rows without a time are left out; those without a key are one key of their own. A key's rows of one trigger are in one task; bound a trigger by its source's maxFilesPerTrigger.
    """
    timed = rows.filter(F.col(ts).isNotNull()).select(key, F.col(ts).cast("timestamp").alias(ts), value).withWatermark(ts, delay)
    processor = LastValue(key, ts, value, rows.schema[value].dataType.simpleString(), milliseconds(idle))
    schema = timed.schema
    return timed.groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
