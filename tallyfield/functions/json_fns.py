"""JSON text: access, change, comparison and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW = "map<string,string>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_of(x, *keys: str) -> Column:
    """The text of the first key that is there."""
    return F.coalesce(*[F.get_json_object(_c(x), f"$.{k}") for k in keys])


def has(x, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(_c(x)), key), F.lit(False))


def _bound(x: Column, f) -> Column:
    """f of x, which is worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def raw_map(x) -> Column:
    """Top-level keys to the JSON text of their values, whatever their kind: strings stay quoted."""
    keys = F.coalesce(F.json_object_keys(_c(x)), F.array().cast("array<string>"))
    own = lambda known: F.map_filter(F.from_json(_c(x), "map<string,variant>"), lambda k, v: F.array_contains(known, k))
    return F.transform_values(_bound(keys, own), lambda k, v: F.to_json(v))


def from_raw(m: Column) -> Column:
    """JSON text of a map from keys to JSON texts, keys in order."""
    entries = F.array_sort(F.map_entries(m))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))


def merged(a, b, drop: tuple[str, ...] = ()) -> Column:
    """Keys of both, those of b winning, less those in drop; nested values stay as they are. Each text is parsed once."""

    def both(p):
        m = F.map_concat(F.map_filter(p["a"], lambda k, v: ~F.map_contains_key(p["b"], k)), p["b"])
        return from_raw(F.map_filter(m, lambda k, v: ~k.isin(list(drop))) if drop else m)

    return _bound(F.struct(raw_map(a).alias("a"), raw_map(b).alias("b")), both)


def without(x, *keys: str) -> Column:
    return from_raw(F.map_filter(raw_map(x), lambda k, v: ~k.isin(list(keys))))


def same(a, b) -> Column:
    """Equal as JSON, whatever the order of keys."""
    return F.to_json(F.try_parse_json(_c(a))).eqNullSafe(F.to_json(F.try_parse_json(_c(b))))


def profile(df: DataFrame, column: str) -> DataFrame:
    """For each top-level path: kinds of values, rows with it, all rows, nullable, distinct values."""
    values = df.select(F.explode(F.from_json(column, "map<string,variant>")).alias("k", "v"))
    kind = F.lower(F.schema_of_variant("v"))
    named = values.select(F.concat(F.lit("$."), "k").alias("path"), F.when(kind == "bigint", "int").otherwise(kind).alias("kind"), F.to_json("v").alias("value"))
    per_kind = named.groupBy("path", "kind").agg(F.count("*").alias("n"))
    kinds = per_kind.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "kind"))), lambda s: s["kind"]), "|").alias("types"))
    seen = named.groupBy("path").agg(F.count("*").alias("present"), F.count_distinct("value").alias("cardinality"), F.bool_or(F.col("kind") == "void").alias("has_null"))
    total = df.agg(F.count("*").alias("total"))
    out = seen.join(kinds, "path").crossJoin(total)
    return out.select("path", "types", "present", "total", (F.col("has_null") | (F.col("present") < F.col("total"))).alias("nullable"), "cardinality")
