"""Scans and sinks, each sink read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.sources import files as S
from tallyfield.session import fresh_path

from .registry import QUERIES, query

SEEDS = """
# labels of nations
nations:
  - name: NATION_0
    value: Zero
    aliases: [nought, nil]
  - name: NATION_1
    value: One
    aliases: [single]
  - name: NATION_7
    value: Seven
"""


@query("SELECT * FROM nation")
def scan_table(t, spark):
    return t("nation")


@query("SELECT vec_id, embedding IS NOT NULL AS has_vector FROM embeddings")
def scan_project(t, spark):
    return t("embeddings").select("vec_id", F.col("embedding").isNotNull().alias("has_vector"))


@query("SELECT count(*) AS files, 5 AS parts FROM range(5)")
def scan_keys(t, spark):
    path = fresh_path(spark, "keys")
    S.write_archive(t("events").groupBy("event_type").agg(F.count("*").alias("n")).coalesce(1), path, ["event_type"])
    keys = S.keys_under(spark, path, "*.json")
    return keys.agg(F.count("*").alias("files"), F.count_distinct(F.regexp_extract("path", "event_type=([a-z]+)", 1)).cast("int").alias("parts"))


@query("SELECT event_id, event_type FROM events WHERE event_id % 10 <> 0")
def scan_json(t, spark):
    path = fresh_path(spark, "json")
    line = F.when(F.col("event_id") % 10 == 0, '{"event_id": oops').otherwise(F.to_json(F.struct("event_id", "event_type")))
    t("events").select(line.alias("value")).write.text(path)
    good, _ = S.read_json(spark, path, "event_id bigint, event_type string")
    return good.select("event_id", "event_type")


@query("SELECT event_id, day(ts) AS day FROM events WHERE event_type = 'error'")
def scan_key_regex(t, spark):
    path = fresh_path(spark, "archive")
    rows = t("events").filter("event_type = 'error'").select("event_id", F.lit(-1).alias("day"), F.dayofmonth("ts").alias("d"))
    S.write_archive(rows, path, ["d"])
    good, _ = S.read_json(spark, path, "event_id bigint, day bigint")
    return S.from_key(good, "file", {"day": (r"/d=(\d+)/", "bigint")}).select("event_id", "day")


@query("""SELECT n_nationkey, v.value AS label FROM nation LEFT JOIN (VALUES ('NATION_0', 'Zero'), ('NATION_1', 'One'), ('NATION_7', 'Seven')) v(name, value) ON n_name = v.name""")
def scan_yaml(t, spark):
    seeds = S.dictionary(spark, SEEDS)
    return t("nation").join(seeds, F.col("n_name") == F.col("name"), "left").select("n_nationkey", F.col("value").alias("label"))


@query("SELECT event_type AS job, arg_max(CASE WHEN value > 100 THEN 'FAIL' ELSE 'OK' END, (epoch_us(date_trunc('second', ts)) - 1704067200000000) * 100000 + event_id) AS status, count(*) AS lines FROM events GROUP BY 1")
def scan_log(t, spark):
    path = fresh_path(spark, "log")
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("] "), "event_type", F.lit(": "), F.when(F.col("value") > 100, "FAIL").otherwise("OK"), F.lit(" event "), F.col("event_id").cast("string"), F.lit(" rc=1"))
    t("events").select(line.alias("value")).unionAll(spark.createDataFrame([("Traceback (most recent call last):",)], "value string")).write.text(path)
    rows = S.read_log(spark, path).withColumn("n", F.regexp_extract("body", r"(\d+)", 1).cast("long"))
    return rows.groupBy("job").agg(F.max_by("status", F.struct("ts", "n")).alias("status"), F.count("*").alias("lines"))


def scan_catalog(spark, sf_dir):
    return S.table_sizes(spark, sf_dir).limit(20)


QUERIES["scan_catalog"] = scan_catalog


@query("SELECT n_nationkey, n_name FROM nation")
def sink_insert(t, spark):
    path = fresh_path(spark, "insert")
    for part in (0, 1):
        S.append(t("nation").filter(f"n_nationkey % 2 = {part}").select("n_nationkey", "n_name"), path)
    return spark.read.parquet(path)


@query("SELECT user_id, count(*) AS n, event_type FROM events GROUP BY user_id, event_type")
def sink_archive(t, spark):
    path = fresh_path(spark, "archive")
    rows = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    for _ in range(2):  # the second write replaces the first
        S.write_archive(rows, path, ["event_type"])
    return spark.read.schema("user_id bigint, n bigint, event_type string").json(path)


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS event_type FROM events")
def sink_jsonl(t, spark):
    path = fresh_path(spark, "events")
    S.write_events(t("events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("event_type")), path)
    return spark.read.schema("event_id bigint, event_type string").json(path)


@query("SELECT vec_id, len(embedding) AS dims, round(embedding[1]::DOUBLE, 6) AS head FROM embeddings")
def sink_npz(t, spark):
    path = fresh_path(spark, "vectors")
    S.write_vectors(t("embeddings").select("vec_id", "embedding"), path)
    return spark.read.parquet(path).select("vec_id", F.size("embedding").cast("long").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 6).alias("head"))
