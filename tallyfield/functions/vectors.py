"""Vectors as arrays of doubles, by native array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def guarded_norm(a) -> Column:
    """The norm, or 1 for a zero vector."""
    n = norm(a)
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a, b) -> Column:
    return dot(a, b) / (guarded_norm(a) * guarded_norm(b))


def l2_normalise(a) -> Column:
    n = guarded_norm(a)
    return F.transform(_c(a), lambda x: x / n)


def is_finite(a) -> Column:
    """False for null, empty, NaN and infinite components."""
    return F.coalesce(F.size(_c(a)) > 0, F.lit(False)) & F.coalesce(F.forall(_c(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


#: References that a registry may hold: it comes to every task as one row.
MOST_REFERENCES = 10_000


def registry(refs: DataFrame, ref_id: str, q: str = "q") -> DataFrame:
    """One row with all references, array `refs` of (r, q) in the order of ids; more than MOST_REFERENCES raise an error."""
    rows = refs.select(F.struct(F.col(ref_id).alias("r"), F.col(q).alias("q")).alias("ref")).limit(MOST_REFERENCES + 1)
    all_refs = F.array_sort(F.collect_list("ref"))
    return rows.agg(F.when(F.size(all_refs) <= MOST_REFERENCES, all_refs).otherwise(F.raise_error(F.lit("the registry of references is too large")).cast(rows.select(F.array("ref")).schema[0].dataType)).alias("refs"))


def best_reference(v, refs) -> Column:
    """Of an array of references the (c, r) with the greatest cosine c, the least id on ties; null of an empty one."""
    scored = F.transform(_c(refs), lambda x: F.struct(cosine(_c(v), x["q"]).alias("c"), (-x["r"]).alias("o"), x["r"].alias("r")))
    return F.array_max(scored)


def nearest_of(rows: DataFrame, refs: DataFrame, row_id: str, ref_id: str, least: float, name: str) -> DataFrame:
    """The reference with the greatest cosine to each row, or null below `least`; columns v of rows and q of refs.

    refs is a registry of bounded size, which is checked; it meets the rows as one row, so nothing is multiplied or shuffled.
    """
    best = rows.join(registry(refs, ref_id)).withColumn("b", best_reference("v", "refs"))
    return best.select(row_id, F.when(F.col("b.c") >= least, F.col("b.r")).alias(name))


def centroids(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """The mean vector of each key, component by component."""
    parts = df.select(*keys, F.posexplode(v).alias("k", "x")).groupBy(*keys, "k").agg(F.avg("x").alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("centroid"))
