"""Clustering of one source's points, and assignment to centroids over all rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.functions import vectors as V
from tallyfield.operators import density
from tallyfield.session import fresh_path, stored


def merge_close(means: np.ndarray, sizes: np.ndarray, eps: float, least: int) -> list[int]:
    """For each cluster the merged cluster it ends in, or -1 below `least` points: the closest pair within eps merges until none is.

    Each cluster waits in a heap with the nearest one after it. A merge measures anew from the moved mean, and for those whose nearest one has moved or gone; memory is that of
    one row of distances, and 5,000 clusters take seconds. Of equal distances the first pair in order merges.
    """
    n = len(means)
    if not n:
        return []
    means, sizes = np.array(means, float), list(sizes)
    alive, into = np.ones(n, bool), list(range(n))
    near, to, turn = np.full(n, np.inf), np.full(n, -1), [0] * n
    waiting: list[tuple[float, int, int]] = []

    def measure(a: int) -> None:
        """The nearest living cluster after a."""
        turn[a] += 1
        later = np.flatnonzero(alive[a + 1 :]) + a + 1
        near[a] = np.inf
        if len(later):
            d = np.sqrt(((means[a] - means[later]) ** 2).sum(-1))
            k = int(d.argmin())
            near[a], to[a] = d[k], later[k]
            heappush(waiting, (float(d[k]), a, turn[a]))

    for a in range(n):
        measure(a)
    while waiting:
        d, a, t = heappop(waiting)
        if not alive[a] or t != turn[a]:
            continue
        if d > eps:
            break
        b = int(to[a])
        total = sizes[a] + sizes[b]
        means[a] = (means[a] * sizes[a] + means[b] * sizes[b]) / total
        sizes[a], alive[b], into[b] = total, False, a
        measure(a)
        for k in np.flatnonzero(alive[:b] & ((to[:b] == a) | (to[:b] == b))).tolist():
            if k != a:
                measure(k)
        before = np.flatnonzero(alive[:a])
        if len(before):
            d = np.sqrt(((means[before] - means[a]) ** 2).sum(-1))
            for k in np.flatnonzero((d < near[before]) | (d == near[before]) & (a < to[before])).tolist():
                at = int(before[k])
                near[at], to[at] = d[k], a
                turn[at] += 1
                heappush(waiting, (float(d[k]), at, turn[at]))
    number = {int(k): g for g, k in enumerate(np.flatnonzero(alive))}
    out = []
    for k in range(n):
        while into[k] != k:
            k = into[k]
        out.append(number[k] if sizes[k] >= least else -1)
    return out


def source(keys: list[str]) -> Column:
    """One number for the keys of a source; null keys are ordinary values."""
    return F.xxhash64(*[x for k in keys for x in (F.col(k), F.col(k).isNull())])


def in_sources(rows: DataFrame, keys: list[str], point_id: str, fit) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """rows with `__g` and the size `__n` of their source; and a function that gives (__g, id, cluster) of chosen rows, a source in one task, stored."""
    numbered = rows.select(*keys, point_id, "v", source(keys).alias("__g"))
    sized = numbered.join(numbered.groupBy("__g").agg(F.count("*").alias("__n")), "__g")
    kind = numbered.schema[point_id].dataType

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(point_id, kind="stable")
        x = np.stack(group["v"].to_numpy())
        labels = fit(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
        return group[["__g", point_id]].assign(cluster=pd.array([None if k < 0 else k for k in labels], "Int64"))

    schema = T.StructType([T.StructField("__g", T.LongType()), T.StructField(point_id, kind), T.StructField("cluster", T.LongType())])
    return sized, lambda chosen: stored(chosen.select("__g", point_id, "v").groupBy("__g").applyInPandas(cluster, schema), "fitted")


def cluster_bounded(rows: DataFrame, keys: list[str], point_id: str, least: int, most: int = 5000, noise: float = 0.25, floor: float = 0.35) -> DataFrame:
    """(keys, id, cluster): density clusters of a sample of each key's vectors v, null for noise; no task holds more than about `most` points of a key.

    Keys with up to `most` points are clustered whole. Of larger ones a sample by hash is, about `most` points, and the others go to the
    nearest centroid in a join, if its cosine is `floor` or more. A member whose cosine to its cluster's mean is below `noise` is noise. Rows with null keys are a source like any other. See density() for large keys without a sample.
    """
    sized, fit = in_sources(rows, keys, point_id, lambda x: near_members(x, least, noise))
    share = F.pmod(F.xxhash64(point_id), F.lit(1_000_000)) * F.col("__n") < F.lit(most * 1_000_000)
    sized = sized.withColumn("__in", (F.col("__n") <= most) | share)
    fitted = fit(sized.filter("__in"))
    members = sized.filter(F.col("__n") > most).join(fitted.filter("cluster IS NOT NULL"), ["__g", point_id])
    means = V.centroids(members, ["__g", "cluster"], "v")
    others = assign(sized.filter("NOT __in"), means, ["__g"], point_id, floor).select("__g", point_id, "cluster")
    return with_keys(rows, fitted.unionByName(others), keys, point_id)


def with_keys(rows: DataFrame, found: DataFrame, keys: list[str], point_id: str) -> DataFrame:
    return rows.select(*keys, point_id, source(keys).alias("__g")).join(found, ["__g", point_id]).select(*keys, point_id, "cluster")


def density_clusters_of(rows: DataFrame, keys: list[str], point_id: str, least: int, most: int = 5000, noise: float = 0.25) -> DataFrame:
    """(keys, id, cluster): density clusters of all of each key's vectors v, null for noise; ids are whole numbers, each once in a key.

    Keys of up to `most` points are clustered in a task each, others by rounds over blocks of points: the same clusters. A member whose cosine to its cluster's mean is below `noise` is noise. Null keys are a source like any other.
    """
    sized, fit = in_sources(rows, keys, point_id, lambda x: near_members(x, least, noise))
    small = fit(sized.filter(F.col("__n") <= most))
    large = sized.filter(F.col("__n") > most)
    if large.isEmpty():
        return with_keys(rows, small, keys, point_id)
    units = stored(large.select(F.col("__g").alias("g"), F.col(point_id).cast("long").alias("id"), V.l2_normalise("v").alias("v")), "points")
    found = stored(density.large_clusters(units, least), "clusters").join(units, ["g", "id"]).filter("cluster >= 0")
    means = V.centroids(found, ["g", "cluster"], "v")
    near = found.join(means, ["g", "cluster"]).filter(V.cosine("v", "centroid") >= noise).select("g", "id", "cluster")
    labelled = units.select("g", "id").join(near, ["g", "id"], "left").select(F.col("g").alias("__g"), F.col("id").cast(rows.schema[point_id].dataType).alias(point_id), "cluster")
    return with_keys(rows, small.unionByName(labelled), keys, point_id)


def near_members(x: np.ndarray, least: int, noise: float) -> list[int]:
    """Density clusters of unit vectors; a member whose cosine to the mean of its cluster is below `noise` is noise, -1."""
    labels = np.array(density.density_clusters(x, least), int)
    out = labels.copy()
    for k in range(labels.max(initial=-1) + 1):
        mean = x[labels == k].mean(axis=0)
        out[(labels == k) & (x @ mean < noise * max(np.linalg.norm(mean), 1e-12))] = -1
    return out.tolist()


def pair_greedy(pairs: DataFrame, keys: list[str], a: str, b: str, weight: str, rounds: int = 200) -> DataFrame:
    """Of the pairs (keys, a, b, weight), each once, those that greed takes within each key: one to one, the heaviest first; ties by a, then b.

    A pair that is the first one for both its ends is taken whatever happens elsewhere, so each round takes all of these and drops the pairs that share an end
    with them. That is the result of taking one after another, and no key's pairs need to be in one task. Left pairs are stored after each round. Pairs without a weight come last; ends that are null are ordinary values.
    """
    spark = pairs.sparkSession
    order = F.struct(F.col(weight).isNull().alias("none"), (-F.col(weight)).alias("w"), F.col(a).alias("a"), F.col(b).alias("b"))
    names = [*keys, a, b, weight]
    left, taken = pairs.select(*names), []
    for _ in range(rounds):
        first = lambda end: F.min(order).over(Window.partitionBy(*keys, end))
        marked = left.withColumn("__taken", first(a).eqNullSafe(order) & first(b).eqNullSafe(order))
        # whether either end of a pair is taken now
        gone = lambda end: F.max("__taken").over(Window.partitionBy(*keys, end))
        path = fresh_path(spark, "pairs")
        marked.withColumn("__gone", gone(a) | gone(b)).filter("__taken or not __gone").drop("__gone").write.partitionBy("__taken").parquet(path)
        seen = spark.read.schema(marked.schema).parquet(path)
        taken.append(seen.filter("__taken").select(*names))
        left = seen.filter("not __taken").select(*names)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, taken)
    raise RuntimeError(f"pairs are left after {rounds} rounds")


def assign(points: DataFrame, centroids: DataFrame, keys: list[str], point_id: str, floor: float) -> DataFrame:
    """The centroid nearest by cosine to each point of the same keys, null below the floor or without a centroid; columns v of points, cluster and centroid of centroids."""
    refs = centroids.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("cluster").alias("r"), F.col("centroid").alias("q")))).alias("__refs"))
    best = points.select(*keys, point_id, "v").join(refs, keys, "left").withColumn("__b", V.best_reference("v", "__refs"))
    return best.select(*keys, point_id, F.when(F.col("__b.c") >= floor, F.col("__b.r")).alias("cluster"), F.col("__b.c").alias("sim"))


class Online:
    """The running means of one key, for points that come one after another."""

    def __init__(self, eps: float):
        self.eps, self.means, self.sizes = eps, np.zeros((0, 2)), []

    def place(self, point: np.ndarray) -> int:
        """The nearest mean within eps, which moves, or a new one."""
        d = np.hypot(*(self.means - point).T) if len(self.sizes) else np.array([np.inf])
        k = int(d.argmin())
        if d[k] > self.eps:
            self.means = np.concatenate([self.means, [point]])
            self.sizes.append(1)
            return len(self.sizes) - 1
        self.sizes[k] += 1
        self.means[k] += (point - self.means[k]) / self.sizes[k]
        return k


def online_clusters(df: DataFrame, key: str, order: str, eps: float) -> DataFrame:
    """(key, order, x, y, cluster) of points x, y: rows are streamed in order, and a task holds the means of one key only. A point without a place has no cluster."""

    def over(batches):
        now, means = None, None
        for b in batches:
            out: list[int | None] = []
            for k, x, y in zip(*(b.column(c).to_pylist() for c in (key, "x", "y")), strict=True):
                if means is None or k != now:
                    now, means = k, Online(eps)
                out.append(None if x is None or y is None else means.place(np.array([x, y])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "cluster"])

    rows = df.select(key, order, "x", "y").repartition(key).sortWithinPartitions(key, order)
    return rows.mapInArrow(over, T.StructType([*rows.schema, T.StructField("cluster", T.LongType())]))
