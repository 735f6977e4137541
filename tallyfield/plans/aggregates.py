"""Counts, pivots, modes, votes, profiles and rollups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.functions import vectors as V
from tallyfield.operators import aggregates as A
from tallyfield.operators import joins as J

from .joins import LONGEST, OTHERS, SECONDS, TEN, TURNS, other_spans, seconds, turns
from .registry import query

TYPES = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def agg_count_group(t, spark):
    return t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in TYPES) + " FROM events GROUP BY 1")
def agg_pivot_counts(t, spark):
    return A.pivot_counts(t("events"), ["user_id"], "event_type", TYPES)


@query("SELECT coalesce(max(value), 0) AS top, count(*) AS n FROM events WHERE event_type = 'error'")
def agg_scalar(t, spark):
    return t("events").filter("event_type = 'error'").agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("top"), F.count("*").alias("n"))


@query("SELECT o.o_orderpriority, count(DISTINCT o.o_custkey) AS customers, count(DISTINCT l.l_partkey) AS parts FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1")
def agg_distinct(t, spark):
    rows = t("orders").select("o_orderkey", "o_orderpriority", "o_custkey").join(t("lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("l_partkey").alias("parts"))


@query("""SELECT user_id, CAST(coalesce(sum(greatest(0, d)), 0) AS BIGINT) AS gained FROM (SELECT user_id, CAST(round(value) AS BIGINT) - lag(CAST(round(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events) GROUP BY 1""")
def agg_sum_coalesce(t, spark):
    v = F.round("value").cast("long")
    rows = t("events").select("user_id", (v - F.lag(v).over(Window.partitionBy("user_id").orderBy("ts"))).alias("d"))
    return rows.groupBy("user_id").agg(F.coalesce(F.sum(F.greatest(F.lit(0), "d")), F.lit(0)).alias("gained"))


@query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_return FROM lineitem GROUP BY 1")
def agg_bool_or(t, spark):
    return t("lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_return"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
def agg_having(t, spark):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 15")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def agg_distinct_rows(t, spark):
    return t("lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("""SELECT count(*) AS registered, count(n) AS transcribed, count(*) FILTER (WHERE n >= 2) AS chunked, count(*) FILTER (WHERE r > 0) AS cleaned, count(*) FILTER (WHERE r = n) AS extracted
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) n, count(*) FILTER (WHERE l_returnflag = 'R') r FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def agg_funnel_global(t, spark):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    rows = t("orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.agg(F.count("*").alias("registered"), F.count("n").alias("transcribed"), F.count_if(F.expr("n >= 2")).alias("chunked"), F.count_if(F.expr("r > 0")).alias("cleaned"), F.count_if(F.expr("r = n")).alias("extracted"))


@query("""SELECT CAST(sum(tracked) AS BIGINT) AS tracked, CAST(sum(greatest(gap, 0)) AS BIGINT) AS missing, count(*) FILTER (WHERE gap > 0) AS with_gap, CAST(sum(done) AS BIGINT) AS done FROM
    (SELECT c.c_custkey, coalesce(o.n, 0) AS tracked, coalesce(o.f, 0) AS done, c.c_custkey % 20 - coalesce(o.n, 0) AS gap FROM customer c
     LEFT JOIN (SELECT o_custkey, count(*) n, count(*) FILTER (WHERE o_orderstatus = 'F') f FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey)""")
def agg_funnel_group(t, spark):
    orders = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("tracked"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    rows = t("customer").select("c_custkey").join(orders, "c_custkey", "left").fillna(0).withColumn("gap", F.col("c_custkey") % 20 - F.col("tracked"))
    return rows.agg(F.sum("tracked").alias("tracked"), F.sum(F.greatest("gap", F.lit(0))).alias("missing"), F.count_if(F.expr("gap > 0")).alias("with_gap"), F.sum("done").alias("done"))


@query("""SELECT user_id, event_type, n, n / total AS share FROM (SELECT user_id, event_type, n, sum(n) OVER (PARTITION BY user_id) total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, event_type) rn
    FROM (SELECT user_id, event_type, count(*) n, min(ts) f FROM events GROUP BY 1, 2)) WHERE rn = 1""")
def agg_argmax_mode(t, spark):
    return A.mode_share(t("events"), ["user_id"], "event_type", ("first_seen", F.min("ts")))


@query("""SELECT label, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id, count(*) FILTER (WHERE vec_id % 2 = 0) AS eligible, array_to_string(list(vec_id ORDER BY vec_id)[1:5], ',') AS head FROM embeddings GROUP BY 1""")
def agg_cluster_profile(t, spark):
    ids = F.slice(F.array_sort(F.collect_list("vec_id")), 1, 5)
    return t("embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"), F.count_if(F.expr("vec_id % 2 = 0")).alias("eligible"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("head"))


@query(f"""WITH p AS (SELECT q.label AS a, o.word AS b, q.turn_id % 2 = 0 AS active FROM ({TURNS}) q JOIN ({OTHERS}) o ON q.user_id % 10 = o.user_id % 10 AND o.s BETWEEN q.t0 AND q.t1)
    SELECT a, b, n, n_active, n / sum(n) OVER (PARTITION BY a) AS share_a, n / sum(n) OVER (PARTITION BY b) AS share_b, least(n / sum(n) OVER (PARTITION BY a), n / sum(n) OVER (PARTITION BY b)) AS confidence
    FROM (SELECT a, b, count(*) n, count(*) FILTER (WHERE active) n_active FROM p GROUP BY 1, 2) WHERE n >= 5""")
def agg_cooccurrence(t, spark):
    at = other_spans(t).select(F.expr(TEN).alias("g"), F.col("word").alias("b"), F.col("s").alias("at"))
    held = turns(t).select(F.expr(TEN).alias("g"), "turn_id", F.col("label").alias("a"), "t0", "t1")
    pairs = J.range_join(at, held, ["g"], "at", "t0", "t1", 1800, longest=LONGEST).groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.expr("turn_id % 2 = 0")).alias("n_active")).filter("n >= 5")
    share = lambda c: F.col("n") / F.sum("n").over(Window.partitionBy(c))
    return pairs.withColumn("share_a", share("a")).withColumn("share_b", share("b")).withColumn("confidence", F.least("share_a", "share_b"))


@query(f"""WITH h AS (SELECT CAST(floor(min({SECONDS}) / 900) AS BIGINT) AS lo, CAST(ceil((max({SECONDS}) + 7200) / 900) AS BIGINT) AS hi FROM events), g AS (SELECT x * 900.0 AS at, u AS g FROM (SELECT unnest(range(lo, hi + 1)) AS x FROM h), range(0, 10) s(u)),
    a AS (SELECT g.g, g.at, min_by(label, t0) AS l FROM g JOIN ({TURNS}) q ON q.user_id % 10 = g.g AND g.at >= t0 AND g.at < t1 GROUP BY 1, 2),
    b AS (SELECT g.g, g.at, min_by(word, s) AS w FROM g JOIN ({OTHERS}) o ON o.user_id % 10 = g.g AND g.at >= s AND g.at < e GROUP BY 1, 2)
    SELECT a.l, b.w, count(*) AS n FROM a JOIN b ON a.g = b.g AND a.at = b.at GROUP BY 1, 2""")
def agg_confusion(t, spark):
    # from the first event to the end of the last span
    ends = t("events").agg(F.floor(F.min(seconds()) / 900).cast("long").alias("lo"), F.ceil((F.max(seconds()) + 7200) / 900).cast("long").alias("hi"))
    grid = ends.select(F.explode(F.sequence("lo", "hi")).alias("x")).select((F.col("x") * 900.0).alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("g"))
    a = J.first_interval(grid, turns(t).select(F.expr(TEN).alias("g"), "label", "t0", "t1"), ["g"], ["g", "at"], "at", "t0", "t1", 1800, closed=False, longest=LONGEST)
    b = J.first_interval(grid, other_spans(t).select(F.expr(TEN).alias("g"), "word", "s", "e"), ["g"], ["g", "at"], "at", "s", "e", 1800, closed=False, longest=LONGEST)
    both = a.select("g", "at", F.col("label").alias("l")).join(b.select("g", "at", F.col("word").alias("w")), ["g", "at"])
    return both.groupBy("l", "w").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT a.label AS cluster, a.vec_id, b.vec_id AS ref, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) c FROM embeddings a, embeddings b WHERE a.vec_id >= 10 AND b.vec_id < 10),
    w AS (SELECT cluster, vec_id, arg_max(ref, c) AS ref, max(c) AS c FROM s GROUP BY 1, 2),
    v AS (SELECT cluster, ref, count(*) n, max(c) m FROM w WHERE c >= 0.3 GROUP BY 1, 2),
    k AS (SELECT cluster, arg_max(ref, n * 10 + m) AS ref, max(n) AS votes FROM v GROUP BY 1)
    SELECT t.cluster, votes, votes / total AS agreement, CASE WHEN votes / total >= 0.1 THEN ref END AS winner FROM (SELECT label AS cluster, count(*) total FROM embeddings WHERE vec_id >= 10 GROUP BY 1) t JOIN k ON t.cluster = k.cluster""")
def agg_vote(t, spark):
    rows = t("embeddings").select("vec_id", F.col("label").alias("cluster"), V.doubles("embedding").alias("v"))
    refs = rows.filter("vec_id < 10").select(F.col("vec_id").alias("ref"), F.col("v").alias("q"))
    return vote(rows.filter("vec_id >= 10"), refs, 0.3, 0.1)


def vote(windows, refs, least: float, agree: float):
    """Each window's nearest reference votes if near enough; the winner by votes, then similarity, needs a share of all windows."""
    best = windows.join(V.registry(refs, "ref")).select("cluster", "vec_id", V.best_reference("v", "refs").alias("b"))
    votes = best.filter(F.col("b.c") >= least).groupBy("cluster", F.col("b.r").alias("ref")).agg(F.count("*").alias("n"), F.max("b.c").alias("m"))
    top = votes.groupBy("cluster").agg(F.max(F.struct("n", "m", "ref")).alias("w"))
    total = windows.groupBy("cluster").agg(F.count("*").alias("total"))
    out = total.join(top, "cluster").select("cluster", F.col("w.n").alias("votes"), (F.col("w.n") / F.col("total")).alias("agreement"), F.col("w.ref").alias("ref"))
    return out.select("cluster", "votes", "agreement", F.when(F.col("agreement") >= agree, F.col("ref")).alias("winner"))


@query("""WITH a AS (SELECT user_id, CAST(ts AS DATE) d, event_type, count(*) n FROM events WHERE value >= 50 GROUP BY ALL), al AS (SELECT user_id, CAST(ts AS DATE) d, count(*) total FROM events GROUP BY ALL),
    s AS (SELECT user_id, d, sum(n) active, arg_max(event_type, n * 1000 - ascii(event_type)) AS top, max(n) AS votes FROM a GROUP BY ALL)
    SELECT s.user_id, s.d, CASE WHEN active / total >= 0.3 AND votes / active >= 0.6 THEN top END AS winner, votes / active AS agreement FROM s JOIN al ON s.user_id = al.user_id AND s.d = al.d""")
def agg_vote_gated(t, spark):
    rows = t("events").select("user_id", F.to_date("ts").alias("d"), "event_type", (F.col("value") >= 50).alias("active"))
    per = rows.groupBy("user_id", "d", "event_type").agg(F.count_if(F.expr("active")).alias("n"), F.count("*").alias("m"))
    s = per.groupBy("user_id", "d").agg(F.sum("n").alias("active"), F.sum("m").alias("total"), F.max_by("event_type", F.col("n") * 1000 - F.ascii("event_type")).alias("top"), F.max("n").alias("votes")).filter("active > 0")
    share = F.col("votes") / F.col("active")
    return s.select("user_id", "d", F.when((F.col("active") / F.col("total") >= 0.3) & (share >= 0.6), F.col("top")).alias("winner"), share.alias("agreement"))


@query("SELECT user_id, round(stddev_pop(value), 6) AS spread, round(sqrt(var_pop(value) + var_pop(event_id)), 4) AS motion, least(1, count(*) / greatest(1, max(day(ts)) - min(day(ts)))) AS density FROM events GROUP BY 1")
def agg_stats_std(t, spark):
    day = F.dayofmonth("ts")
    return t("events").groupBy("user_id").agg(F.round(F.stddev_pop("value"), 6).alias("spread"), F.round(F.sqrt(F.var_pop("value") + F.var_pop("event_id")), 4).alias("motion"), F.least(F.lit(1.0), F.count("*") / F.greatest(F.lit(1), F.max(day) - F.min(day))).alias("density"))


@query("SELECT d.source, round(avg(l.quality), 3) AS quality, count(l.quality) AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def agg_avg_null(t, spark):
    rows = t("documents").select("doc_id", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(F.round(F.avg("quality"), 3).alias("quality"), F.count("quality").alias("labelled"))


@query("""SELECT user_id, bin, arg_max(event_id, value * 10000000 - event_id) AS event_id FROM (SELECT *, CAST(least(4, floor(5 * (day(ts) - 1) / 31)) AS INTEGER) AS bin FROM events) GROUP BY 1, 2""")
def agg_bin_argmax(t, spark):
    bins = F.least(F.lit(4), F.floor(5 * (F.dayofmonth("ts") - 1) / 31)).cast("int")
    return t("events").withColumn("bin", bins).groupBy("user_id", "bin").agg(F.max_by("event_id", F.col("value") * 10000000 - F.col("event_id")).alias("event_id"))


@query("""SELECT o_custkey, b AS buy, s AS sell, h AS hold, round(greatest(b, s, h) / (b + s + h), 3) AS score FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') b, count(*) FILTER (WHERE o_orderstatus = 'F') s, count(*) FILTER (WHERE o_orderstatus = 'P') h FROM orders GROUP BY 1)""")
def agg_consensus(t, spark):
    c = t("orders").groupBy("o_custkey").agg(*[F.count_if(F.col("o_orderstatus") == k).alias(n) for k, n in (("O", "buy"), ("F", "sell"), ("P", "hold"))])
    return c.withColumn("score", F.round(F.greatest("buy", "sell", "hold") / (F.col("buy") + F.col("sell") + F.col("hold")), 3))


@query("""SELECT k, arg_max(event_id, ts) AS newest, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failures, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM (SELECT *, json_extract_string(props, '$.k') k FROM events) GROUP BY 1""")
def agg_rollup_runs(t, spark):
    rows = t("events").withColumn("k", F.get_json_object("props", "$.k"))
    return rows.groupBy("k").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"), F.count("*").alias("runs"), F.count_if(F.expr("event_type = 'error'")).alias("failures"), A.exact_sum("value").alias("cost"))


@query(r"""SELECT regexp_extract(h, '^(\w+)Error', 1) AS class, count(*) AS n FROM (SELECT CASE WHEN value > 150 THEN 'ValueError: ' WHEN value > 50 THEN 'KeyError: ' ELSE 'TypeError: ' END || event_id AS h FROM events WHERE event_type = 'error') GROUP BY 1""")
def agg_error_classes(t, spark):
    line = F.concat(F.when(F.col("value") > 150, "ValueError: ").when(F.col("value") > 50, "KeyError: ").otherwise("TypeError: "), F.col("event_id").cast("string"))
    return t("events").filter("event_type = 'error'").select(F.regexp_extract(line, r"^(\w+)Error", 1).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("""SELECT '$.k' AS path, 'int' AS types, count(*) AS present, count(*) AS total, false AS nullable, count(DISTINCT json_extract_string(props, '$.k')) AS cardinality FROM events""")
def agg_profile_json(t, spark):
    from tallyfield.functions.json_fns import profile

    return profile(t("events").select("props"), "props")


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def agg_concat(t, spark):
    return A.ordered_text(t("conversations"), ["conv_id"], "turn", "text", "text")


@query("""SELECT l_returnflag, spend, CAST(sum(spend) OVER () AS DOUBLE) AS total FROM (SELECT l_returnflag || l_linestatus AS l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) spend FROM lineitem GROUP BY 1 HAVING spend > 1000)""")
def agg_spend_group(t, spark):
    kept = t("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("l_returnflag")).agg(A.exact_sum("l_extendedprice").alias("spend")).filter("spend > 1000")
    return kept.crossJoin(kept.agg(A.exact_sum("spend").alias("total")))


@query("""SELECT conv_id, pos AS turn_place, idx AS word_place, word FROM (SELECT conv_id, pos, unnest(string_split(txt, ' ')[1:3]) AS word, generate_subscripts(string_split(txt, ' ')[1:3], 1) AS idx FROM
    (SELECT conv_id, text txt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations))""")
def agg_positions(t, spark):
    lists = t("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: F.slice(F.split(s["text"], " ", -1), 1, 3)).alias("lists"))
    outer = lists.select("conv_id", F.posexplode("lists").alias("p", "words"))
    return outer.select("conv_id", (F.col("p") + 1).cast("long").alias("turn_place"), F.posexplode("words").alias("w", "word")).select("conv_id", "turn_place", (F.col("w") + 1).cast("long").alias("word_place"), "word")


@query("SELECT l_shipdate, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1")
def agg_filter(t, spark):
    return t("lineitem").groupBy("l_shipdate").agg(F.count("*").alias("n"), F.count_if(F.expr("l_discount > 0.05")).alias("discounted"))


@query("SELECT day, min(iso) AS first_iso, max(iso) AS last_iso, bool_or(iso LIKE '%T23%') AS late FROM (SELECT day(ts) AS day, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events) GROUP BY 1")
def agg_minmax_iso(t, spark):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t("events").groupBy(F.dayofmonth("ts").cast("long").alias("day")).agg(F.min(iso).alias("first_iso"), F.max(iso).alias("last_iso"), F.bool_or(iso.contains("T23")).alias("late"))


@query("SELECT user_id, max(ts) AS sampled_at FROM events GROUP BY 1")
def agg_metric_latest(t, spark):
    return t("events").groupBy("user_id").agg(F.max("ts").alias("sampled_at"))


@query("""SELECT open, big, urgent, old, lost, CASE WHEN old > 1000 THEN 'FAILED' WHEN urgent > 100 THEN 'WARN' ELSE 'HEALTHY' END AS status FROM (SELECT count(*) FILTER (WHERE o_orderstatus = 'O') open, count(*) FILTER (WHERE o_totalprice > 300000) big,
    count(*) FILTER (WHERE o_orderpriority = '1-URGENT') urgent, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01') old, count(*) FILTER (WHERE o_custkey IS NULL) lost FROM orders)""")
def agg_backlog(t, spark):
    from tallyfield.functions.scoring import ladder

    rules = {"open": "o_orderstatus = 'O'", "big": "o_totalprice > 300000", "urgent": "o_orderpriority = '1-URGENT'", "old": "o_orderdate < TIMESTAMP_NTZ '1996-01-01'", "lost": "o_custkey IS NULL"}
    counts = t("orders").agg(*[F.count_if(F.expr(e)).alias(n) for n, e in rules.items()])
    return counts.withColumn("status", ladder([(F.col("old") > 1000, "FAILED"), (F.col("urgent") > 100, "WARN")], "HEALTHY"))


@query("""SELECT user_id, CASE WHEN n = 0 THEN 'UNKNOWN' WHEN f > 0 THEN 'FAILED' ELSE 'HEALTHY' END AS status, f AS failures FROM (SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-28') n, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-28' AND event_type = 'error') f FROM events GROUP BY 1)""")
def agg_failed_recent(t, spark):
    recent = F.col("ts") >= F.lit("2024-01-28").cast("timestamp_ntz")
    c = t("events").groupBy("user_id").agg(F.count_if(recent).alias("n"), F.count_if(recent & (F.col("event_type") == "error")).alias("failures"))
    return c.select("user_id", F.when(F.col("n") == 0, "UNKNOWN").when(F.col("failures") > 0, "FAILED").otherwise("HEALTHY").alias("status"), "failures")


@query("""SELECT count(*) FILTER (WHERE last IS NULL) AS missing, count(*) FILTER (WHERE last < TIMESTAMP '2024-01-30') AS stale, array_to_string(list(c_custkey ORDER BY c_custkey) FILTER (WHERE last IS NULL)[1:5], ',') AS sample
    FROM customer LEFT JOIN (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) ON c_custkey = user_id""")
def agg_stale_missing(t, spark):
    last = t("events").groupBy("user_id").agg(F.max("ts").alias("last"))
    rows = t("customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("user_id"), "left")
    sample = rows.filter("last IS NULL").orderBy("c_custkey").limit(5).agg(F.array_join(F.array_sort(F.collect_list("c_custkey")).cast("array<string>"), ",").alias("sample"))
    return rows.agg(F.count_if(F.expr("last IS NULL")).alias("missing"), F.count_if(F.expr("last < TIMESTAMP_NTZ '2024-01-30'")).alias("stale")).crossJoin(sample)


@query("SELECT user_id, array_to_string(list(event_type || ':' || n ORDER BY event_type), ',') AS counter FROM (SELECT user_id, event_type, count(*) n FROM events GROUP BY 1, 2) GROUP BY 1")
def map_counter(t, spark):
    maps = A.histogram(t("events"), ["user_id"], "event_type", "m")
    return maps.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("counter"))
