"""Readers and writers of archives, logs, dictionaries and vectors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keys_under(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of the files under a folder; contents stay unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def read_json(spark: SparkSession, path, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows with their file, and the text of bad ones: a record that can't be read is a row, not a failure."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    rows = lines.filter(F.trim("value") != "").select("value", "file", F.from_json("value", f"{schema}, _corrupt_record string", options).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull()
    return rows.filter(~bad).select("r.*", "file").drop("_corrupt_record"), rows.filter(bad).select("file", F.col("value").alias("record"))


def from_key(df: DataFrame, file: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """df with typed columns parsed from a path, winning over columns of the same name: name to (pattern with one group, type)."""
    for name, (pattern, kind) in patterns.items():
        found = F.nullif(F.regexp_extract(file, pattern, 1), F.lit("")).try_cast(kind)
        df = df.withColumn(name, F.coalesce(found, F.col(name)) if name in df.columns else found)
    return df


def yaml_entries(text: str) -> list[dict]:
    """The entries of a YAML document: a list of mappings, or a mapping that holds one. Needs the YAML library, without which it is an ImportError."""
    import yaml

    found = yaml.safe_load(text) or []
    return next((v for v in found.values() if isinstance(v, list)), []) if isinstance(found, dict) else found


def dictionary(spark: SparkSession, text: str) -> DataFrame:
    """(name, value, aliases) from a seed dictionary in YAML, entries with these keys. Seeds are small, fixed files."""
    rows = [(str(e["name"]), str(e["value"]), [str(a) for a in e.get("aliases") or []]) for e in yaml_entries(text)]
    return spark.createDataFrame(rows, "name string, value string, aliases array<string>")


LOG_LINE = r"^\[(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ)\] (\S+): (OK|FAIL) (.*?)(?: rc=(\d+))?$"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts, job, status, body, rc) of a line log; lines of another form drop out."""
    part = lambda k: F.regexp_extract("value", LOG_LINE, k)
    rows = spark.read.text(path).filter(F.col("value").rlike(LOG_LINE))
    return rows.select(F.to_timestamp(part(1), "yyyy-MM-dd'T'HH:mm:ssX").cast("timestamp_ntz").alias("ts"), part(2).alias("job"), part(3).alias("status"), part(4).alias("body"), F.nullif(part(5), F.lit("")).try_cast("int").alias("rc"))


def table_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes) of the Parquet tables in a folder, the largest first."""
    files = keys_under(spark, folder, "*.parquet").select(F.regexp_extract("path", r"/([A-Za-z_]+)\.parquet(?:/|$)", 1).alias("name"), "length")
    return files.groupBy("name").agg(F.sum("length").alias("bytes")).orderBy(F.desc("bytes"), "name")


def write_archive(df: DataFrame, path: str, keys: list[str]) -> None:
    """JSON by key folders; a second write of the same keys replaces only their folders."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(path)


def write_events(df: DataFrame, path: str) -> None:
    """Newline-delimited JSON, nulls left out."""
    df.write.mode("append").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors as array columns: the columnar form of an array dump."""
    df.write.mode("overwrite").option("parquet.bloom.filter.enabled", "false").parquet(path)


def dump(rows: list[dict]) -> str:
    return "\n".join(json.dumps(r, sort_keys=True) for r in rows)
