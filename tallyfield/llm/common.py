"""Helpers shared by the text operators: table access, shared scratch tables, Arrow batches, components."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.session import fresh_path, prepare, shared_dir, table  # noqa: F401

#: Bytes of an Arrow batch: texts can be long, so batches stay small in memory.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the user's own bound is lower, and let tasks import this package."""
    prepare(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


#: Folders made since the innermost scratch() began, if there is one.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes with the scratch() around it."""
    path = fresh_path(spark, name)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read again: lineage ends here and lost executors lose nothing."""
    path = temporary(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Delete at its end what operators stored inside. Give kept(df, name), which is yielded, the rows that must outlast it."""
    token = _MADE.set([])
    lasting: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        lasting.append(_MADE.get().pop())
        return out

    try:
        yield kept
    finally:
        made = _MADE.get()
        _MADE.reset(token)
        for path in made:
            delete(spark, path)
        if (outer := _MADE.get()) is not None:
            outer += lasting


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by stored(), once nothing reads it any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for f in df.inputFiles():
        folder = f.rsplit("/", 1)[0]
        if "/" + root.split("://")[-1].strip("/").split("/")[-1] + "/" in folder:
            delete(spark, folder)
            return


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def tasks(df: DataFrame) -> int:
    """Shuffle partitions of the session, for an explicit repartition."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Edges of a graph that one task joins at once: 2 MB.
FEW_EDGES = 1 << 17


def joined_in_task(batches):
    """Arrow batches of all edges (a, b) of a graph to (node, component): the least label of neighbours spreads, and labels follow labels."""
    got = [np.stack([c.to_numpy() for c in b.columns]) for b in batches if b.num_rows]
    if not got:
        return
    nodes, at = np.unique(np.concatenate(got, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        np.minimum.at(label, label[a], label[b])
        np.minimum.at(label, label[b], label[a])
        label = np.minimum(label, label[label])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component being the least node reachable.

    edges has two long columns, a and b, in either order; nodes without an edge don't come back. A graph of up to FEW_EDGES edges,
    which are counted, is joined in one task. In a larger one large-star and
    small-star steps alternate until the edges no longer change: a round is a grouping and a join on a node, no group is
    gathered in one row, and the number of rounds grows with the logarithm of the largest component.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(least, "a")
        if large:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        links = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        return links.filter("a > b").distinct()

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    if now.count() <= FEW_EDGES:
        return stored(now.repartition(1).mapInArrow(joined_in_task, "node long, component long"), "components")
    seen = None
    for _ in range(rounds):
        new = stored(star(star(now, True), False), "edges")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        drop_stored(now)
        now = new
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(nodes.select(F.col("component").alias("node"), "component").distinct())
