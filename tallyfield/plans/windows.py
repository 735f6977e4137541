"""Ordered analytics: changes, runs, running frames, tenures and ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.operators import windows as W

from .joins import SECONDS, seconds
from .registry import query


@query("""SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events) WHERE prev IS NULL OR prev <> event_type""")
def win_lag_change(t, spark):
    return W.change_rows(t("events"), ["user_id"], ["ts"], "event_type").select("event_id", "user_id")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_totalprice > 250000) AS total FROM orders WHERE o_totalprice > 250000 ORDER BY o_orderkey LIMIT 15")
def win_total(t, spark):
    from tallyfield.operators.paging import page

    rows, total = page(t("orders").filter("o_totalprice > 250000"), ["o_orderkey"], 15, 0)
    return rows.select("o_orderkey", F.lit(total).cast("long").alias("total"))


@query("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1")
def win_latest_per_key(t, spark):
    return W.latest_per_key(t("events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "ts")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, month(o_orderdate) DESC, o_orderkey DESC) rn FROM orders) WHERE rn = 1")
def win_latest_row(t, spark):
    return W.latest_per_key(t("orders"), ["o_custkey"], F.year("o_orderdate"), F.month("o_orderdate"), "o_orderkey").select("o_custkey", "o_orderkey")


@query("""SELECT DISTINCT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) rn, 1 AS k FROM events UNION ALL
    SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id), 2 FROM events WHERE event_type = 'error') WHERE rn <= 3""")
def win_topn_per_group(t, spark):
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    newest = W.top_per_key(e, ["user_id"], 3, F.desc("ts"), "event_id")
    failed = W.top_per_key(e.filter("event_type = 'error'"), ["user_id"], 3, F.desc("ts"), "event_id")
    return newest.unionByName(failed).select("event_id").dropDuplicates(["event_id"])


@query(f"SELECT event_id, coalesce(s - lag(s) OVER (PARTITION BY user_id ORDER BY s) > 43200, false) AS gap FROM (SELECT event_id, user_id, {SECONDS} AS s FROM events)")
def win_gap_flag(t, spark):
    s = seconds()
    return t("events").select("event_id", F.coalesce(s - F.lag(s).over(Window.partitionBy("user_id").orderBy("ts")) > 43200, F.lit(False)).alias("gap"))


@query(f"""SELECT event_id, coalesce(lag(event_type) OVER w = event_type AND s - lag(s) OVER w >= 3600, false) AS breaks FROM (SELECT event_id, user_id, event_type, {SECONDS} AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s)""")
def win_paragraph(t, spark):
    w, s = Window.partitionBy("user_id").orderBy("ts"), seconds()
    return t("events").select("event_id", F.coalesce((F.lag("event_type").over(w) == F.col("event_type")) & (s - F.lag(s).over(w) >= 3600), F.lit(False)).alias("breaks"))


@query("""SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM
    (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, g, event_type""")
def win_gaps_islands(t, spark):
    changed = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts")) != F.col("event_type")
    runs = W.islands(t("events"), ["user_id"], ["ts"], changed)
    return runs.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("island")


@query(f"""SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY s) AS g FROM
    (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY s) AND s - lag(s) OVER (PARTITION BY user_id ORDER BY s) <= 21600 THEN 0 ELSE 1 END AS c FROM (SELECT *, {SECONDS} AS s FROM events))) GROUP BY user_id, g, event_type""")
def win_gap_islands(t, spark):
    w, s = Window.partitionBy("user_id").orderBy("ts"), seconds()
    changed = (F.lag("event_type").over(w) != F.col("event_type")) | (s - F.lag(s).over(w) > 21600)
    runs = W.islands(t("events"), ["user_id"], ["ts"], changed)
    return runs.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).drop("island")


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM conversations")
def win_cum_offset(t, spark):
    return W.offsets(t("conversations"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "char_start")


COVER = f"SELECT event_id, user_id, round({SECONDS}, 6) AS s, round({SECONDS} + value * 60, 6) AS e FROM events"


@query(f"""SELECT event_id FROM (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ({COVER})) WHERE NOT coalesce(s < m AND e <= m, false)""")
def win_running_max(t, spark):
    rows = t("events").select("event_id", "user_id", F.round(seconds(), 6).alias("s"), F.round(seconds() + F.col("value") * 60, 6).alias("e"))
    return W.uncovered(rows, ["user_id"], "s", "e", "event_id").select("event_id")


@query("""SELECT conv_id, turn, len(list_filter(list_distinct(string_split(text, ' ')), lambda x: NOT list_contains(coalesce(prev, []), x))) AS fresh FROM (SELECT conv_id, turn, text, flatten(list(string_split(text, ' ')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)) AS prev FROM conversations)""")
def win_lookback_set(t, spark):
    rows = t("conversations").select("conv_id", "turn", F.split("text", " ", -1).alias("w"))
    return W.new_members(rows, ["conv_id"], ["turn"], "w", 2).select("conv_id", "turn", F.size("new_items").cast("long").alias("fresh"))


@query("SELECT event_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS m FROM events) WHERE value = m AND value >= 2.0")
def win_local_max(t, spark):
    return W.local_maxima(t("events"), ["user_id"], ["ts"], "value", 10, 2.0).select("event_id")


@query("SELECT event_id, count(*) FILTER (WHERE event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS active FROM events")
def win_decay(t, spark):
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(-15, 0)
    return t("events").select("event_id", F.count_if(F.col("event_type") == "view").over(w).alias("active"))


@query("""SELECT user_id, CASE WHEN r >= 0.8 THEN 'fast' WHEN r >= 0.7 THEN 'mixed' ELSE 'steady' END AS pace FROM (SELECT user_id, avg((event_type <> p)::INT) r FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) p FROM events) GROUP BY 1)""")
def win_change_rate(t, spark):
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts"))
    rate = t("events").select("user_id", (F.col("event_type") != prev).cast("int").alias("c")).groupBy("user_id").agg(F.avg("c").alias("r"))
    return rate.select("user_id", F.when(F.col("r") >= 0.8, "fast").when(F.col("r") >= 0.7, "mixed").otherwise("steady").alias("pace"))


@query("""SELECT user_id, d, event_id FROM (SELECT user_id, CAST(ts AS DATE) AS d, event_id, value, lead(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY value DESC, event_id) AS second, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY value DESC, event_id) AS rn FROM events)
    WHERE rn = 1 AND value >= 60 AND value - coalesce(second, 0) >= 5""")
def win_pick_active(t, spark):
    w = Window.partitionBy("user_id", "d").orderBy(F.desc("value"), "event_id")
    rows = t("events").select("user_id", F.to_date("ts").alias("d"), "event_id", "value")
    ranked = rows.withColumn("second", F.lead("value").over(w)).withColumn("rn", F.row_number().over(w))
    return ranked.filter((F.col("rn") == 1) & (F.col("value") >= 60) & (F.col("value") - F.coalesce("second", F.lit(0.0)) >= 5)).select("user_id", "d", "event_id")


@query("""WITH d AS (SELECT user_id, day(ts) // 8 AS w, arg_max(event_type, n * 1000 - ascii(event_type)) AS top FROM (SELECT user_id, ts, event_type, count(*) OVER (PARTITION BY user_id, day(ts) // 8, event_type) n FROM events) GROUP BY 1, 2)
    SELECT user_id, w, top, coalesce(top <> lag(top) OVER (PARTITION BY user_id ORDER BY w), false) AS flipped FROM d""")
def win_flip(t, spark):
    rows = t("events").select("user_id", F.floor(F.dayofmonth("ts") / 8).alias("w"), "event_type").groupBy("user_id", "w", "event_type").agg(F.count("*").alias("n"))
    top = rows.groupBy("user_id", "w").agg(F.max_by("event_type", F.col("n") * 1000 - F.ascii("event_type")).alias("top"))
    return top.withColumn("flipped", F.coalesce(F.col("top") != F.lag("top").over(Window.partitionBy("user_id").orderBy("w")), F.lit(False)))


@query("""SELECT event_type, row_number() OVER (ORDER BY n DESC, event_type) - 1 AS cluster, CASE row_number() OVER (ORDER BY m, event_type) WHEN 1 THEN 'left' WHEN k THEN 'right' ELSE 'centre' END AS side
    FROM (SELECT event_type, count(*) n, avg(user_id) m, (SELECT count(DISTINCT event_type) FROM events) k FROM events GROUP BY 1)""")
def win_rank_label(t, spark):
    c = t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("user_id").alias("m"))  # a row a cluster
    by_size, by_place = Window.orderBy(F.desc("n"), "event_type"), Window.orderBy("m", "event_type")
    place, k = F.row_number().over(by_place), F.count("*").over(Window.partitionBy())
    return c.select("event_type", (F.row_number().over(by_size).cast("long") - 1).alias("cluster"), F.when(place == 1, "left").when(place == k, "right").otherwise("centre").alias("side"))


@query("""WITH r AS (SELECT *, sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS g FROM (SELECT *, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) THEN 0 ELSE 1 END AS c FROM orders)),
    q AS (SELECT o_custkey, g, o_orderstatus, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day, count(*) AS n FROM r GROUP BY ALL)
    SELECT o_custkey, o_orderstatus, first_day, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY g DESC) = 1 AND last_day >= TIMESTAMP '2000-06-01' - INTERVAL '365' DAY THEN NULL ELSE last_day END AS last_day, n FROM q""")
def win_tenure(t, spark):
    order = ["o_orderdate", "o_orderkey"]
    changed = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy(*order)) != F.col("o_orderstatus")
    runs = W.islands(t("orders"), ["o_custkey"], order, changed).groupBy("o_custkey", "island", "o_orderstatus").agg(F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last"), F.count("*").alias("n"))
    newest = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("island"))) == 1
    still = newest & (F.col("last") >= F.lit("2000-06-01").cast("timestamp_ntz") - F.expr("INTERVAL '365' DAY"))
    return runs.select("o_custkey", "o_orderstatus", "first_day", F.when(~still, F.col("last")).alias("last_day"), "n")


@query("SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS place FROM lineitem")
def win_positional(t, spark):
    lists = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    return lists.select("l_orderkey", F.posexplode("lines").alias("place", "x")).select("l_orderkey", "x.l_partkey", F.col("place").cast("long").alias("place"))


@query("""SELECT user_id, event_type, first_ts, CASE WHEN nxt IS NULL THEN NULL ELSE greatest(first_ts, nxt - INTERVAL '1' DAY) END AS effective_to FROM
    (SELECT user_id, event_type, min(ts) AS first_ts, lead(min(ts)) OVER (PARTITION BY user_id ORDER BY min(ts)) AS nxt FROM events GROUP BY 1, 2)""")
def tenure_close(t, spark):
    first = t("events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"))
    nxt = F.lead("first_ts").over(Window.partitionBy("user_id").orderBy("first_ts"))
    return first.select("user_id", "event_type", "first_ts", F.when(nxt.isNotNull(), F.greatest("first_ts", nxt - F.expr("INTERVAL '1' DAY"))).alias("effective_to"))


@query("SELECT conv_id, turn, text FROM (SELECT *, max(e) OVER (PARTITION BY conv_id ORDER BY s, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT conv_id, turn, text, turn * 50 AS s, turn * 50 + length(text) AS e FROM conversations WHERE trim(text) <> '')) WHERE NOT coalesce(s < m AND e <= m, false)")
def stitch(t, spark):
    rows = t("conversations").filter(F.trim("text") != "").select("conv_id", "turn", "text", (F.col("turn") * 50).alias("s"), (F.col("turn") * 50 + F.length("text")).alias("e"))
    return W.uncovered(rows, ["conv_id"], "s", "e", "turn").select("conv_id", "turn", "text")
