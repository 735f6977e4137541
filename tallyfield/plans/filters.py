"""Projections, predicates, decision ladders, sorting, paging, and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.functions.scoring import bounded_score, keyword_labels, ladder, token_cost
from tallyfield.operators import paging
from tallyfield.operators.sets import case_insensitive_first, presence

from .registry import query

NOW = "2024-01-31 00:00:00"
CATEGORIES = {"motion": ["ing", "tion"], "articles": ["the "], "plural": ["es "], "short": ["of ", "to "], "rare": ["zz"]}


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority = '1-URGENT' AND o_totalprice >= 100000")
def filter_eq_in(t, spark):
    wanted = {"o_orderstatus": ["O", "F"], "o_orderpriority": "1-URGENT", "o_clerk": None}
    rules = [F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v for c, v in wanted.items() if v is not None]
    return t("orders").filter(reduce(lambda a, b: a & b, rules)).filter("o_totalprice >= 100000").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT doc_id, lang FROM documents WHERE lang = ANY(['de', 'fr'])")
def filter_any_param(t, spark):
    return t("documents").filter(F.col("lang").isin(["de", "fr"])).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE list_contains(string_split(lower(text), ' '), 'the')")
def filter_array_member(t, spark):
    words = F.split(F.lower("text"), " ", -1)
    return t("documents").filter(F.coalesce(F.array_contains(words, "the"), F.lit(False))).select("doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'SMALL%' OR lower(p_name) LIKE '%ring%'")
def filter_ilike(t, spark):
    return t("part").filter(F.col("p_name").ilike("SMALL%") | F.lower("p_name").like("%ring%")).select("p_partkey", "p_name")


@query(f"SELECT event_id FROM events WHERE (CASE WHEN event_type = 'view' THEN NULL ELSE ts + INTERVAL '7' DAY END) IS NULL OR ts + INTERVAL '7' DAY > TIMESTAMP '{NOW}'")
def filter_ttl(t, spark):
    expires = F.when(F.col("event_type") != "view", F.col("ts") + F.expr("INTERVAL '7' DAY"))
    return t("events").filter(expires.isNull() | (expires > F.lit(NOW).cast("timestamp"))).select("event_id")


@query(f"SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL '7' DAY")
def filter_lookback(t, spark):
    return t("events").filter(F.col("ts") > F.lit(NOW).cast("timestamp") - F.expr("INTERVAL '7' DAY")).select("event_id", "user_id")


@query(f"SELECT user_id, max(ts) >= TIMESTAMP '{NOW}' - INTERVAL '12' HOUR AS fresh FROM events GROUP BY user_id")
def filter_recency(t, spark):
    return t("events").groupBy("user_id").agg((F.max("ts") >= F.lit(NOW).cast("timestamp") - F.expr("INTERVAL '12' HOUR")).alias("fresh"))


@query("SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) = 1 AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def null_coalesce(t, spark):
    rows = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))


@query("SELECT d.doc_id, coalesce('q' || l.quality, d.source) AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def null_label(t, spark):
    rows = t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.concat(F.lit("q"), F.col("quality").cast("string")), "source").alias("label"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS DISTINCT FROM l.toxic")
def null_distinct(t, spark):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left").filter(~F.col("quality").eqNullSafe(F.col("toxic"))).select("doc_id")


@query("SELECT event_id, try_cast(nullif(json_extract_string(props, '$.k'), '69') AS INTEGER) AS k FROM events")
def nullif_cast(t, spark):
    k = F.nullif(F.get_json_object("props", "$.k"), F.lit("69"))
    return t("events").select("event_id", k.try_cast("int").alias("k"))


@query("""SELECT o.o_orderkey, CASE WHEN n IS NULL THEN 'registered' WHEN n_r > 0 AND n_r = n THEN 'extracted' WHEN n_r > 0 THEN 'cleaned'
    WHEN n > 3 THEN 'chunked' ELSE 'transcribed' END AS stage
    FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) n, count(*) FILTER (WHERE l_returnflag = 'R') n_r FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey""")
def case_stage(t, spark):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_r"))
    rows = t("orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    stage = ladder([(F.col("n").isNull(), "registered"), ((F.col("n_r") > 0) & (F.col("n_r") == F.col("n")), "extracted"), (F.col("n_r") > 0, "cleaned"), (F.col("n") > 3, "chunked")], "transcribed")
    return rows.select("o_orderkey", stage.alias("stage"))


@query(r"""SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%promo%' THEN 'indefinite' WHEN gap <= 1 THEN 'short' WHEN gap <= 4 THEN 'medium' ELSE 'long' END AS status, gap
    FROM (SELECT *, CAST(greatest(0, try_cast(regexp_extract(p_brand, '(\d+)', 1) AS INTEGER) - 8) AS INTEGER) gap FROM part)""")
def case_status(t, spark):
    gap = F.greatest(F.lit(0), F.regexp_extract("p_brand", r"(\d+)", 1).try_cast("int") - 8)
    rows = t("part").select("p_partkey", "p_type", gap.alias("gap"))
    status = ladder([(F.lower("p_type").contains("promo"), "indefinite"), (F.col("gap") <= 1, "short"), (F.col("gap") <= 4, "medium")], "long")
    return rows.select("p_partkey", status.alias("status"), "gap")


@query("""SELECT conv_id, CASE WHEN n_assistant > 2 THEN 'full' WHEN n_assistant > 0 THEN 'partial' WHEN n_user > 0 THEN 'basic' ELSE 'none' END AS coverage
    FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') n_assistant, count(*) FILTER (WHERE role = 'user') n_user FROM conversations GROUP BY 1)""")
def case_coverage(t, spark):
    by_role = lambda r: F.size(F.filter(F.collect_list("role"), lambda x: x == r))
    sides = t("conversations").groupBy("conv_id").agg(by_role("assistant").alias("a"), by_role("user").alias("u"))
    return sides.select("conv_id", ladder([(F.col("a") > 2, "full"), (F.col("a") > 0, "partial"), (F.col("u") > 0, "basic")], "none").alias("coverage"))


@query("""SELECT user_id, CASE WHEN n < 40 THEN 'noise' WHEN spread < 60 AND top >= 0.25 THEN 'portrait' WHEN n >= 60 AND spread >= 60 THEN 'person' ELSE 'unknown' END AS kind
    FROM (SELECT user_id, n, spread, mx / n AS top FROM
      (SELECT user_id, sum(c) n, max(c) mx, max(s) spread FROM (SELECT user_id, event_type, count(*) c, stddev_pop(value) s FROM events GROUP BY 1, 2) GROUP BY 1))""")
def case_kind(t, spark):
    by_type = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"), F.stddev_pop("value").alias("s"))
    seen = by_type.groupBy("user_id").agg(F.sum("c").alias("n"), F.max("s").alias("spread"), F.max("c").alias("mx")).withColumn("top", F.col("mx") / F.col("n"))
    kind = ladder([(F.col("n") < 40, "noise"), ((F.col("spread") < 60) & (F.col("top") >= 0.25), "portrait"), ((F.col("n") >= 60) & (F.col("spread") >= 60), "person")], "unknown")
    return seen.select("user_id", kind.alias("kind"))


@query("""SELECT d.doc_id, CASE WHEN quality IS NULL AND toxic IS NULL THEN 'none' WHEN quality IS NULL OR toxic IS NULL THEN 'partial' WHEN quality = toxic THEN 'agree' ELSE 'disagree' END AS agreement
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def case_agreement(t, spark):
    from tallyfield.functions.scoring import agreement

    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left").select("doc_id", agreement(F.col("quality"), F.col("toxic")).alias("agreement"))


@query("""WITH v AS (SELECT user_id, arg_max(event_type, value * 100000000 - event_id) a, max(value) ca FROM events WHERE event_id % 2 = 0 GROUP BY 1),
    f AS (SELECT user_id, arg_max(event_type, value * 100000000 - event_id) b, max(value) cb FROM events WHERE event_id % 2 = 1 AND user_id % 7 <> 0 GROUP BY 1)
    SELECT v.user_id, CASE WHEN a = b THEN a WHEN b IS NULL THEN a ELSE NULL END AS identity,
      CASE WHEN a = b THEN least(1.0, (ca + cb) / 2 / 400) WHEN b IS NULL THEN ca / 400 ELSE NULL END AS confidence FROM v LEFT JOIN f ON v.user_id = f.user_id""")
def case_fusion(t, spark):
    from tallyfield.functions.scoring import fuse

    best = lambda rows, a, c: rows.groupBy("user_id").agg(F.max_by("event_type", F.col("value") * 100000000 - F.col("event_id")).alias(a), (F.max("value") / 400).alias(c))
    voice = best(t("events").filter("event_id % 2 = 0"), "a", "ca")
    face = best(t("events").filter("event_id % 2 = 1 AND user_id % 7 <> 0"), "b", "cb")
    rows = voice.join(face, "user_id", "left")
    identity, confidence = fuse(F.col("a"), F.col("ca"), F.col("b"), F.col("cb"))
    return rows.select("user_id", identity.alias("identity"), confidence.alias("confidence"))


@query("""SELECT user_id, CASE max(CASE event_type WHEN 'error' THEN CASE WHEN value > 200 THEN 3 ELSE 2 END WHEN 'view' THEN 1 ELSE 0 END)
    WHEN 3 THEN 'FAILED' WHEN 2 THEN 'WARN' WHEN 1 THEN 'UNKNOWN' ELSE 'HEALTHY' END AS status FROM events GROUP BY user_id""")
def case_health(t, spark):
    from tallyfield.functions.scoring import worst_status

    status = F.when((F.col("event_type") == "error") & (F.col("value") > 200), "FAILED").when(F.col("event_type") == "error", "WARN").when(F.col("event_type") == "view", "UNKNOWN").otherwise("HEALTHY")
    return t("events").groupBy("user_id").agg(worst_status(status).alias("status"))


@query("SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'O' AND o_totalprice < 200000 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def pred_queue(t, spark):
    return t("orders").filter("o_orderstatus = 'O' AND o_totalprice < 200000").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("""SELECT event_id, event_type IN ('view', 'click') AND (event_type = 'view')::INT + (value > 100)::INT + (user_id % 3 = 0)::INT = 1 AS one_of FROM events""")
def pred_arc(t, spark):
    from tallyfield.functions.scoring import exactly_one

    arc = exactly_one(F.when(F.col("event_type") == "view", 1), F.when(F.col("value") > 100, 1), F.when(F.col("user_id") % 3 == 0, 1))
    return t("events").select("event_id", (F.col("event_type").isin("view", "click") & arc).alias("one_of"))


@query("""SELECT doc_id, CAST(round(greatest(0, least(1, CASE WHEN NOT rel THEN least(raw, 0.49) ELSE raw END)), 2) AS DOUBLE) AS score, array_to_string(list_filter([r1, r2, r3, r4], lambda x: x IS NOT NULL), '|') AS reasons FROM (
    SELECT doc_id, text LIKE '%the %' AS rel, (CASE WHEN text LIKE '%the %' THEN 0.45 ELSE 0 END + CASE WHEN n_chars >= 5000 THEN 0.25 WHEN n_chars >= 1000 THEN 0.15 WHEN n_chars >= 300 THEN 0.05 ELSE 0 END
      + CASE WHEN lang = 'en' THEN 0.2 ELSE 0 END + CASE WHEN source = 'src0' THEN 0.6 ELSE 0 END) AS raw,
      CASE WHEN text LIKE '%the %' THEN 'term' END r1, CASE WHEN n_chars >= 1000 THEN 'long' END r2, CASE WHEN lang = 'en' THEN 'english' END r3, CASE WHEN source = 'src0' THEN 'first source' END r4 FROM documents)""")
def score_bounded(t, spark):
    term = F.col("text").contains("the ")
    size = F.when(F.col("n_chars") >= 5000, 0.25).when(F.col("n_chars") >= 1000, 0.15).when(F.col("n_chars") >= 300, 0.05).otherwise(0.0)
    parts = [(term, 0.45, "term"), (None, size, None), (F.col("n_chars") >= 1000, 0.0, "long"), (F.col("lang") == "en", 0.2, "english"), (F.col("source") == "src0", 0.6, "first source")]
    score, reasons = bounded_score(parts, relevant=term, cap=0.49)
    return t("documents").select("doc_id", score.alias("score"), F.array_join(reasons, "|").alias("reasons"))


@query("""SELECT doc_id, CASE WHEN len(c) = 0 THEN 'other' ELSE array_to_string(c[1:4], '|') END AS categories FROM (SELECT doc_id, list_filter([
    CASE WHEN x LIKE '%ing%' OR x LIKE '%tion%' THEN 'motion' END, CASE WHEN x LIKE '%the %' THEN 'articles' END, CASE WHEN x LIKE '%es %' THEN 'plural' END,
    CASE WHEN x LIKE '%of %' OR x LIKE '%to %' THEN 'short' END, CASE WHEN x LIKE '%zz%' THEN 'rare' END], lambda y: y IS NOT NULL) c FROM (SELECT doc_id, lower(text) x FROM documents))""")
def categorise(t, spark):
    return t("documents").select("doc_id", F.array_join(keyword_labels(F.lower("text"), CATEGORIES, 4, "other"), "|").alias("categories"))


@query("""SELECT user_id, round(sum(CAST(value * (CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 15 ELSE 5 END) * 100 AS BIGINT)) / 100 / 1e6, 8) AS cost FROM events GROUP BY user_id""")
def cost_estimate(t, spark):
    prices = spark.createDataFrame([("view", 3.0), ("click", 15.0)], "model string, price double")
    priced = token_cost(t("events").withColumnRenamed("event_type", "model"), prices, "value", default=5.0, cents=True)
    return priced.groupBy("user_id").agg(F.round(F.sum("cents") / 100 / 1e6, 8).alias("cost"))


@query("""SELECT event_type, mtd, mtd + mtd / 20.0 * (31 - 20) AS month_end FROM (SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) mtd FROM events WHERE ts < TIMESTAMP '2024-01-21' GROUP BY 1)""")
def project_forecast(t, spark):
    from tallyfield.functions.scoring import month_end
    from tallyfield.operators.aggregates import exact_sum

    spent = t("events").filter("ts < TIMESTAMP '2024-01-21'").groupBy("event_type").agg(exact_sum("value").alias("mtd"))
    return spent.select("event_type", "mtd", month_end(F.col("mtd"), F.lit("2024-01-20").cast("date")).alias("month_end"))


@query("SELECT d.doc_id, l.quality, row_number() OVER (ORDER BY l.quality DESC NULLS LAST, d.doc_id) AS place FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY place LIMIT 100")
def sort_nulls(t, spark):
    rows = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left").orderBy(F.desc_nulls_last("quality"), "doc_id").limit(100)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("quality"), "doc_id")).cast("long"))


@query("SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 50")
def sort_multi(t, spark):
    return t("orders").orderBy("o_orderpriority", F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority", "o_orderdate")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def sort_dynamic(t, spark):
    return paging.sorted_by(t("customer"), "balance", {"balance": F.desc("c_acctbal"), "name": F.asc("c_name")}, "c_custkey").limit(25).select("c_custkey", "c_acctbal")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def topk(t, spark):
    return t("documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def page_offset(t, spark):
    rows, total = paging.page(t("orders").filter("o_orderstatus = 'F'"), ["o_orderkey"], 20, 40)
    return rows.select("o_orderkey", F.lit(total).cast("long").alias("total"))


@query("""SELECT event_id, ts, (SELECT count(*) FROM (SELECT 1 FROM events WHERE ts < TIMESTAMP '2024-01-15' LIMIT 31)) > 30 AS has_more FROM events WHERE ts < TIMESTAMP '2024-01-15' ORDER BY ts DESC, event_id DESC LIMIT 30""")
def page_keyset(t, spark):
    return paging.before(t("events").select("event_id", "ts"), "ts", "event_id", "2024-01-15", 30)


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS ids FROM (SELECT vec_id FROM embeddings LIMIT 200)")
def sample_seeded(t, spark):
    return paging.seeded_sample(t("embeddings"), "vec_id", 200, seed=7).agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"))


@query("""SELECT event_id, gap FROM (SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts) AS gap FROM events) WHERE gap IS NOT NULL ORDER BY gap DESC, event_id LIMIT 10""")
def longest_n(t, spark):
    gap = F.unix_micros(F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts")).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return t("events").select("event_id", gap.alias("gap")).filter("gap IS NOT NULL").orderBy(F.desc("gap"), "event_id").limit(10)


@query("SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('view', 'error') OR user_id < 20")
def set_union(t, spark):
    e = t("events").select("user_id", "event_type")
    return e.filter(F.col("event_type").isin("view", "error")).unionByName(e.filter("user_id < 20")).dropDuplicates(["user_id", "event_type"])


@query("SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-10' EXCEPT SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00'")
def set_diff(t, spark):
    e = t("events")
    return e.filter("ts < TIMESTAMP '2024-01-10'").select("user_id").distinct().join(e.filter("ts >= TIMESTAMP '2024-01-30 12:00:00'"), "user_id", "left_anti")


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) w FROM conversations)
    SELECT a.conv_id, len(list_intersect(a.w, b.w)) AS shared FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1""")
def set_intersect(t, spark):
    w = t("conversations").select("conv_id", "turn", F.split(F.lower("text"), " ", -1).alias("w"))
    a, b = w.filter("turn = 0").select("conv_id", F.col("w").alias("wa")), w.filter("turn = 1").select("conv_id", F.col("w").alias("wb"))
    return a.join(b, "conv_id").select("conv_id", F.size(F.array_intersect("wa", "wb")).cast("long").alias("shared"))


@query("""SELECT user_id, max((event_type = 'view')::INT) = 1 AS in_view, max((event_type = 'click')::INT) = 1 AS in_click, max((event_type = 'error')::INT) = 1 AS in_error,
    NOT (max((event_type = 'view')::INT) = max((event_type = 'click')::INT) AND max((event_type = 'click')::INT) = max((event_type = 'error')::INT)) AS mismatch
    FROM events WHERE event_type IN ('view', 'click', 'error') AND day(ts) = 3 GROUP BY user_id""")
def set_presence(t, spark):
    e = t("events").filter("day(ts) = 3")
    return presence({k: e.filter(F.col("event_type") == k).select("user_id") for k in ("view", "click", "error")}, "user_id")


@query("""SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents d WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 100) GROUP BY 1""")
def dedup_hash(t, spark):
    docs = t("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    seen = docs.filter("doc_id < 100").select("content_hash")
    return docs.join(seen, "content_hash", "left_anti").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""SELECT lower(w) AS word, arg_min(w, p) AS first_form, min(p) AS place FROM (SELECT unnest(string_split(text, ' ')) w, generate_subscripts(string_split(text, ' '), 1) + doc_id * 100000 p FROM documents WHERE lang = 'de') GROUP BY 1 ORDER BY place LIMIT 100""")
def dedup_case(t, spark):
    words = t("documents").filter("lang = 'de'").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("at", "w")).select("w", (F.col("doc_id") * 100000 + F.col("at") + 1).alias("p"))
    return case_insensitive_first(words, "w", "p", 100)


@query("""SELECT m.kind, count(*) AS n FROM events e JOIN (VALUES ('view', 'seen'), ('click', 'acted'), ('purchase', 'acted')) m(event_type, kind) ON e.event_type = m.event_type GROUP BY 1""")
def dedup_normalise(t, spark):
    synonyms = spark.createDataFrame([("view", "seen"), ("click", "acted"), ("purchase", "acted")], "event_type string, kind string")
    return t("events").join(synonyms, "event_type").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents d WHERE n_chars >= 4000 AND lang = 'en'")
def filter_min_score(t, spark):
    from tallyfield.operators.paging import optional

    return optional(t("documents"), {"lang": "en", "source": None}, "n_chars", 4000).select("doc_id")


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL ORDER BY p_brand, n DESC, p_size LIMIT 40")
def sort_client(t, spark):
    return t("part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n")).orderBy("p_brand", F.desc("n"), "p_size").limit(40)
