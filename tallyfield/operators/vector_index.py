"""An inverted file of vectors: a table in cells around centroids, so that a search reads the files of few cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.functions import vectors as V

#: Centroids that every task may hold, and vectors from which they are fitted on the driver.
MOST_CELLS, SAMPLED = 10_000, 20_000


def fitted(x: np.ndarray, cells: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors by cosine: each moves to the mean of the vectors nearest to it; one without any stays."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        for k in range(len(c)):
            if (at == k).any():
                m = x[at == k].sum(0)
                c[k] = m / max(np.linalg.norm(m), 1e-12)
    return c


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


class CellIndex:
    """Rows of a table with vectors, stored by cell, and what is known of each cell: its centroid and the angle to its farthest member."""

    def __init__(self, spark: SparkSession, path: str, vector: str):
        self.spark, self.path, self.vector = spark, path, vector
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()
        self.cell, self.radius = cells["cell"].to_numpy(), np.arccos(np.clip(cells["least"].to_numpy(float), -1, 1))
        self.centroids = np.stack(cells["centroid"].to_numpy()) if len(cells) else np.zeros((0, 1))

    @classmethod
    def build(cls, df: DataFrame, id_col: str, vector: str, cells: int, path: str, rows_per_file: int = 500_000) -> CellIndex:
        """Every row of df with a usable vector goes to the cell of the nearest centroid by cosine; rows of null, zero or non-finite vectors are left out.

        Centroids are fitted to SAMPLED vectors at most, those of the least hashes of ids. A large cell is dealt to several files.
        """
        if cells > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} cells")
        spark = df.sparkSession
        usable = df.withColumn(vector, V.doubles(vector)).filter(V.is_finite(vector)).filter(V.norm(vector) > 0)
        sample = usable.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLED).select(vector).toPandas()[vector]
        centroids = fitted(unit(np.stack(sample.to_numpy())), cells) if len(sample) else np.zeros((0, 1))
        sent = spark.sparkContext.broadcast(centroids)

        def deal(batches):
            for b in batches:
                if b.num_rows:
                    near = unit(np.stack(b.column(vector).to_numpy(zero_copy_only=False))) @ sent.value.T
                    at = near.argmax(1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(near[np.arange(len(at)), at])], names=[*b.schema.names, "cell", "near"])

        placed = usable.mapInArrow(deal, T.StructType([*usable.schema, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())]))
        placed.write.parquet(f"{path}/placed")
        placed = spark.read.schema(placed.schema).parquet(f"{path}/placed")
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least"))
        files = F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_file))
        dealt = placed.join(F.broadcast(sizes.select("cell", files.alias("files"))), "cell").withColumn("file", F.pmod(F.xxhash64(id_col), "files"))  # MOST_CELLS rows at most
        dealt.repartition("cell", "file").select(*[c for c in placed.columns if c not in ("near",)]).write.partitionBy("cell").parquet(f"{path}/rows")
        rows = [(k, c.tolist()) for k, c in enumerate(centroids)]
        known = spark.createDataFrame(rows, "cell int, centroid array<double>").join(sizes, "cell")
        known.select("cell", "centroid", "n", "least").write.parquet(f"{path}/cells")
        return cls(spark, path, vector)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def angles(self, probe: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(self.centroids @ (probe / max(np.linalg.norm(probe), 1e-12)), -1, 1))

    def scored(self, probe: np.ndarray, cells: list[int]) -> DataFrame:
        """Rows of these cells with `cos`; only their folders are read."""
        q = F.array(*[F.lit(float(x)) for x in probe])
        return self.rows().filter(F.col("cell").isin([int(c) for c in cells])).withColumn("cos", V.cosine(self.vector, q))

    def search(self, probe, id_col: str, k: int, cells: int = 4, where=None, exact: bool = False) -> DataFrame:
        """The k rows nearest to a vector by cosine, ties by id, with `cos`, from the `cells` cells of nearest centroids.

        exact: the k-th of these then rules out every cell whose centroid is so far that no member can be nearer, and the others are read too. where is a condition on rows.
        """
        probe = np.asarray(probe, float)
        angle = self.angles(probe)
        order = np.argsort(angle, kind="stable")
        near, rest = order[:cells], order[cells:]
        top = lambda at: (lambda d: d if where is None else d.filter(where))(self.scored(probe, self.cell[at].tolist())).orderBy(F.desc("cos"), id_col).limit(k)
        found = top(near)
        if not exact or not len(rest):
            return found.drop("cell")
        kth = found.agg(F.min("cos"), F.count("*")).first()
        reach = np.arccos(np.clip(kth[0], -1, 1)) + 1e-6 if kth[1] == k else np.pi  # rounding must not rule out an equal one
        more = rest[angle[rest] - self.radius[rest] <= reach]
        return (top(np.concatenate([near, more])) if len(more) else found).drop("cell")
