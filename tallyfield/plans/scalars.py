"""Scalar, array and JSON functions on the tables nearest to their use."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import json_fns as J
from tallyfield.functions import numbers as N
from tallyfield.functions import text as X
from tallyfield.functions import urls as U
from tallyfield.functions import vectors as V

from .registry import query

CODES = {"AUT": "Automobile", "BUI": "Building", "FUR": "Furniture"}
SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query(rf"SELECT page_id, {SQUEEZE.format(r'''regexp_replace(html, '<[^>]+>', ' ', 'g')''')} AS text FROM pages")
def str_clean_html(t, spark):
    return t("pages").select("page_id", X.clean_html("html").alias("text"))


@query("SELECT s_suppkey, CASE WHEN n LIKE '%,%' THEN trim(n[strpos(n, ',') + 1:]) || ' ' || trim(n[:strpos(n, ',') - 1]) ELSE trim(n) END AS name FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN replace(s_name, '#', ', ') ELSE s_name END AS n FROM supplier)")
def str_name_flip(t, spark):
    n = F.when(F.col("s_suppkey") % 2 == 0, F.replace("s_name", F.lit("#"), F.lit(", "))).otherwise(F.col("s_name"))
    return t("supplier").select("s_suppkey", X.flip_name(n).alias("name"))


@query(rf"SELECT c_custkey, {SQUEEZE.format(r'''regexp_replace(lower(c_name || '  O''Neil-' || c_mktsegment), '[^a-z0-9\s''\-]', '', 'g')''')} AS name FROM customer")
def str_norm_name(t, spark):
    return t("customer").select("c_custkey", X.norm_name(F.concat("c_name", F.lit("  O'Neil-"), "c_mktsegment")).alias("name"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def str_slug(t, spark):
    return t("part").select("p_partkey", X.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"))


@query(rf"SELECT doc_id, {SQUEEZE.format(r'''regexp_replace(text, '\*{2,}', '*', 'g')''')} AS text FROM documents WHERE text LIKE '%***%'")
def str_star(t, spark):
    return t("documents").filter(F.col("text").contains("***")).select("doc_id", X.collapse_stars("text").alias("text"))


@query("SELECT c_custkey, coalesce(CASE left(c_mktsegment, 3) WHEN 'AUT' THEN 'Automobile' WHEN 'BUI' THEN 'Building' WHEN 'FUR' THEN 'Furniture' END, left(c_mktsegment, 3)) AS segment FROM customer")
def str_team_code(t, spark):
    return t("customer").select("c_custkey", X.coded(F.substring("c_mktsegment", 1, 3), CODES).alias("segment"))


@query(r"SELECT w, regexp_replace(regexp_replace(lower(w), '''(s|re|ve|ll|d|t|m)$', ''), '[^a-z0-9]', '', 'g') AS norm FROM (SELECT DISTINCT unnest(string_split(text, ' ')) || CASE WHEN doc_id % 2 = 0 THEN '''s' ELSE '' END AS w FROM documents)")
def str_word_norm(t, spark):
    end = F.when(F.col("doc_id") % 2 == 0, "'s").otherwise("")
    words = t("documents").select("doc_id", F.explode(F.split("text", " ", -1)).alias("w")).select(F.concat("w", end).alias("w")).distinct()
    return words.select("w", X.word_norm("w").alias("norm"))


TOKENS = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 3)"


@query(f"""WITH k AS (SELECT DISTINCT unnest({TOKENS.format('text')}) AS w FROM benchmark), d AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS w FROM (SELECT doc_id, coalesce({TOKENS.format('text')}, []) AS w FROM documents))
    SELECT doc_id, CASE WHEN count(d.w) = 0 THEN 0 ELSE count(k.w) / count(d.w) END AS coverage FROM d LEFT JOIN k USING (w) GROUP BY 1""")
def str_tokens(t, spark):
    # the vocabulary of all items, as a table; a document's words are summed before they are dealt out
    known = t("benchmark").select(F.explode(X.tokens("text")).alias("w")).distinct().withColumn("known", F.lit(1))
    words = t("documents").select("doc_id", F.explode_outer(X.tokens("text")).alias("w")).join(known, "w", "left")
    counted = words.groupBy("doc_id").agg(F.count("known").alias("hits"), F.count("w").alias("n"))
    return counted.select("doc_id", F.when(F.col("n") == 0, 0.0).otherwise(F.col("hits") / F.col("n")).alias("coverage"))


@query("SELECT doc_id, replace(replace(text, 'the their', 'X'), ' tion', '_shun') AS text, len(string_split(text, ' tion')) - 1 AS hits FROM documents")
def str_replace_list(t, spark):
    pairs = [("tio", "short needles stay"), (" tion", "_shun"), ("the their", "X")]
    hits = (F.size(F.split("text", " tion", -1)) - 1).cast("long")
    return t("documents").select("doc_id", X.replace_list("text", pairs).alias("text"), hits.alias("hits"))


@query(r"SELECT doc_id, CASE WHEN contains(text, 'The') THEN regexp_replace(text, 'The', 'That') ELSE regexp_replace(text, 'the', 'That', 'i') END AS text FROM documents")
def str_replace_once(t, spark):
    return t("documents").select("doc_id", X.replace_once("text", "The", "That").alias("text"))


def sounds(word: str) -> str:
    """SQL for the Metaphone code of an expression: each letter by its neighbours, c with p and pp before it and n and m after it."""
    letters = f"upper(regexp_replace(strip_accents({word}), '[^A-Za-z]', '', 'g'))"
    begun = f"(CASE WHEN {letters}[1:2] IN ('AE', 'GN', 'KN', 'PN', 'WR') THEN {letters}[2:] WHEN {letters}[1] = 'X' THEN 'S' || {letters}[2:] WHEN {letters}[1:2] = 'WH' THEN 'W' || {letters}[3:] ELSE {letters} END)"
    vowel, soft = "('A', 'E', 'I', 'O', 'U')", "('E', 'I', 'Y')"
    code = f"""CASE WHEN x.c = x.p AND x.c <> 'C' THEN '' WHEN x.c IN {vowel} THEN CASE WHEN x.i = 1 THEN x.c ELSE '' END WHEN x.c = 'B' THEN CASE WHEN x.n = '' AND x.p = 'M' THEN '' ELSE 'B' END
      WHEN x.c = 'C' THEN CASE WHEN x.n = 'H' THEN CASE WHEN x.p = 'S' THEN 'K' ELSE 'X' END WHEN x.n = 'I' AND x.m = 'A' THEN 'X' WHEN x.n IN {soft} THEN CASE WHEN x.p = 'S' THEN '' ELSE 'S' END ELSE 'K' END
      WHEN x.c = 'D' THEN CASE WHEN x.n = 'G' AND x.m IN {soft} THEN 'J' ELSE 'T' END
      WHEN x.c = 'G' THEN CASE WHEN x.p = 'D' AND x.pp <> 'D' AND x.n IN {soft} THEN '' WHEN x.n = 'H' AND x.m <> '' AND x.m NOT IN {vowel} OR x.n = 'N' AND (x.m = '' OR x.rest = 'ED') THEN '' WHEN x.n IN {soft} AND x.p <> 'G' THEN 'J' ELSE 'K' END
      WHEN x.c = 'H' THEN CASE WHEN x.n IN {vowel} AND x.p NOT IN ('C', 'S', 'P', 'T', 'G') THEN 'H' ELSE '' END WHEN x.c = 'K' THEN CASE WHEN x.p = 'C' THEN '' ELSE 'K' END WHEN x.c = 'P' THEN CASE WHEN x.n = 'H' THEN 'F' ELSE 'P' END
      WHEN x.c = 'Q' THEN 'K' WHEN x.c = 'S' THEN CASE WHEN x.n = 'H' OR x.n = 'I' AND x.m IN ('O', 'A') THEN 'X' ELSE 'S' END
      WHEN x.c = 'T' THEN CASE WHEN x.n = 'I' AND x.m IN ('O', 'A') THEN 'X' WHEN x.n = 'H' THEN '0' WHEN x.n = 'C' AND x.m = 'H' THEN '' ELSE 'T' END
      WHEN x.c = 'V' THEN 'F' WHEN x.c IN ('W', 'Y') THEN CASE WHEN x.n IN {vowel} THEN x.c ELSE '' END WHEN x.c = 'X' THEN 'KS' WHEN x.c = 'Z' THEN 'S' ELSE x.c END"""
    around = f"{{'i': i, 'c': substr({begun}, i, 1), 'p': CASE WHEN i < 2 THEN '' ELSE substr({begun}, i - 1, 1) END, 'pp': CASE WHEN i < 3 THEN '' ELSE substr({begun}, i - 2, 1) END, 'n': substr({begun}, i + 1, 1), 'm': substr({begun}, i + 2, 1), 'rest': substr({begun}, i + 2)}}"
    return f"array_to_string(list_transform(list_transform(range(1, length({begun}) + 1), lambda i: {around}), lambda x: {code}), '')"


@query(f"SELECT DISTINCT p_name, {sounds('p_name')} AS code, {sounds("string_split(p_name, ' ')[1]")} AS first_code FROM part")
def str_metaphone(t, spark):
    return t("part").select("p_name").distinct().select("p_name", X.metaphone("p_name").alias("code"), X.metaphone(F.split("p_name", " ")[0]).alias("first_code"))


def neighbour_names(t):
    """Each part's name beside that of the part with the next key, every pair of names once."""
    a = t("part").select(F.col("p_name").alias("a"), (F.col("p_partkey") + 1).alias("k"))
    return a.join(t("part").select(F.col("p_name").alias("b"), F.col("p_partkey").alias("k")), "k").select("a", "b").distinct()


@query("SELECT DISTINCT a.p_name AS a, b.p_name AS b, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) AS score FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def str_jaro_winkler(t, spark):
    return neighbour_names(t).select("a", "b", F.round(X.jaro_winkler("a", "b"), 6).alias("score"))


@query(f"""SELECT a, b, CASE WHEN ratio < 0.5 THEN 0.0 ELSE round(0.4 * same + 0.4 * jaro_winkler_similarity(lower(a), lower(b)) + 0.2 * ratio, 6) END AS score FROM
    (SELECT a, b, CASE WHEN {sounds('a')} = {sounds('b')} THEN 1.0 ELSE 0.0 END AS same, least(length(a), length(b)) / greatest(length(a), length(b)) AS ratio FROM (SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1))""")
def str_phonetic_score(t, spark):
    return neighbour_names(t).select("a", "b", F.round(X.phonetic_score("a", "b"), 6).alias("score"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 40 THEN left(text, 40) || '…' ELSE text END AS text FROM conversations")
def str_truncate(t, spark):
    return t("conversations").select("conv_id", "turn", X.truncate("text", 40).alias("text"))


@query("SELECT doc_id, length(replace(text, chr(0), '')) AS n FROM documents")
def str_nul_scrub(t, spark):
    return t("documents").select("doc_id", F.length(X.scrub_nul("text")).cast("long").alias("n"))


@query("SELECT o_orderkey, CAST(o_orderkey * 1000 AS BIGINT) AS n, CAST(0 AS BIGINT) AS bad, CAST(NULL AS BIGINT) AS blank FROM orders")
def num_parse_int(t, spark):
    money = F.concat(F.lit("$"), F.format_number(F.col("o_orderkey") * 1000, 0))
    return t("orders").select("o_orderkey", N.parse_int(money).alias("n"), N.parse_int(F.lit("12.5")).cast("long").alias("bad"), N.parse_int(F.lit(" ")).cast("long").alias("blank"))


@query("SELECT o_orderkey, o_totalprice AS n, 0.0::DOUBLE AS bad FROM orders")
def num_parse_float(t, spark):
    return t("orders").select("o_orderkey", N.parse_float(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("n"), N.parse_float(F.lit("n/a")).alias("bad"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN NULL ELSE value END AS value FROM events")
def num_safe_float(t, spark):
    raw = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "x").otherwise(F.col("value").cast("string"))
    return t("events").select("event_id", N.safe_float(raw).alias("value"))


@query("SELECT c_custkey, CAST(('0x' || left(md5(lower(c_name) || '|' || lower(c_mktsegment)), 8))::BIGINT & 2147483647 AS BIGINT) AS id FROM customer")
def num_hash_id(t, spark):
    return t("customer").select("c_custkey", N.hash_id("c_name", "c_mktsegment").alias("id"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) END AS ts FROM events")
def date_parse(t, spark):
    raw = F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("not a time")
    return t("events").select("event_id", N.parse_rfc3339(raw).cast("timestamp_ntz").alias("ts"))


@query("SELECT p_partkey, CAST(greatest(0, p_size - 10) AS INTEGER) AS gap FROM part")
def date_round_gap(t, spark):
    return t("part").select("p_partkey", N.round_gap(F.lit(10), "p_size").alias("gap"))


VIDEO = "'https://' || CASE page_id % 4 WHEN 0 THEN 'www.youtube.com/watch?list=x&v=' WHEN 1 THEN 'youtu.be/' WHEN 2 THEN 'youtube.com/shorts/' ELSE 'example.com/' END || left(md5(url), 11)"


def video_url():
    form = F.when(F.col("page_id") % 4 == 0, "www.youtube.com/watch?list=x&v=").when(F.col("page_id") % 4 == 1, "youtu.be/").when(F.col("page_id") % 4 == 2, "youtube.com/shorts/").otherwise("example.com/")
    return F.concat(F.lit("https://"), form, F.substring(F.md5("url"), 1, 11))


@query("SELECT page_id, CASE WHEN page_id % 4 < 3 THEN left(md5(url), 11) END AS video_id FROM pages")
def url_video_id(t, spark):
    return t("pages").select("page_id", U.video_id(video_url()).alias("video_id"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'UC' || left(md5(url), 22) WHEN 1 THEN '@' || left(md5(url), 8) END AS channel FROM pages")
def url_channel_id(t, spark):
    md = F.md5("url")
    address = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://youtube.com/channel/UC"), F.substring(md, 1, 22))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://youtube.com/@"), F.substring(md, 1, 8))).otherwise("https://youtube.com/")
    return t("pages").select("page_id", U.channel_id(address).alias("channel"))


@query(f"SELECT page_id, string_split(string_split(u, 'v=')[-1], '&')[1] AS id FROM (SELECT page_id, {VIDEO} || '&t=1' AS u FROM pages)")
def url_naive_id(t, spark):
    return t("pages").select("page_id", U.naive_id(F.concat(video_url(), F.lit("&t=1"))).alias("id"))


@query(r"SELECT conv_id, turn, array_to_string(regexp_extract_all(l, '\[\[([^\]|]+)', 1), ',') AS links FROM (SELECT conv_id, turn, regexp_replace(text, '(\w+) (\w+)', '[[\1]] [[\2|x]]', 'g') AS l FROM conversations)")
def text_wiki_links(t, spark):
    linked = F.regexp_replace("text", r"(\w+) (\w+)", "[[$1]] [[$2|x]]")
    return t("conversations").select("conv_id", "turn", F.array_join(X.wiki_links(linked), ",").alias("links"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos
    FROM embeddings b JOIN (SELECT label, min(vec_id) AS vec_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) a ON a.label = b.label AND a.vec_id < b.vec_id""")
def math_cosine(t, spark):
    # each vector with the first one of its label
    v = t("embeddings").select("vec_id", "label", V.doubles("embedding").alias("v"))
    first = v.groupBy("label").agg(F.min("vec_id").alias("a"), F.min_by("v", "vec_id").alias("va"))
    return v.join(first, "label").filter("a < vec_id").select("a", F.col("vec_id").alias("b"), F.round(V.cosine("va", "v"), 6).alias("cos"))


@query("SELECT vec_id, round(list_sum(list_transform(e, lambda x: (x / n) * (x / n))), 6) AS unit, round(e[1] / n, 6) AS head FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def math_l2norm(t, spark):
    u = t("embeddings").select("vec_id", V.l2_normalise(V.doubles("embedding")).alias("u"))
    return u.select("vec_id", F.round(V.dot("u", "u"), 6).alias("unit"), F.round(F.col("u")[0], 6).alias("head"))


@query("""SELECT label, arg_min(vec_id, round(d, 9) * 1000000 + vec_id / 1000.0) AS medoid FROM (SELECT a.label, a.vec_id, sum(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY 1, 2) GROUP BY 1""")
def math_medoid(t, spark):
    # the sum of cosines to all is one dot product with the sum of unit vectors, so no pairs are made
    u = t("embeddings").select("vec_id", "label", V.l2_normalise(V.doubles("embedding")).alias("u"))
    total = V.centroids(u, ["label"], "u").join(u.groupBy("label").agg(F.count("*").alias("n")), "label")
    d = F.col("n") - F.col("n") * V.dot("u", "centroid")
    return u.join(total, "label").groupBy("label").agg(F.min_by("vec_id", F.round(d, 9) * 1000000 + F.col("vec_id") / 1000.0).alias("medoid"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 9) AS d FROM lineitem")
def math_dist(t, spark):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.sqrt(F.pow("l_quantity", F.lit(2)) + F.pow("l_tax", F.lit(2))), 9).alias("d"))


@query("SELECT p_partkey, CAST(greatest(0, least(p_size, 30) - greatest(p_partkey % 40, 10)) AS BIGINT) AS overlap FROM part")
def math_overlap(t, spark):
    return t("part").select("p_partkey", F.greatest(F.lit(0), F.least("p_size", F.lit(30)) - F.greatest(F.col("p_partkey") % 40, F.lit(10))).cast("long").alias("overlap"))


@query("""SELECT conv_id, turn, s / 2.0 AS start_s, least(s / 2.0 + 2.0, d) AS end_s FROM (SELECT conv_id, turn, d, unnest(CASE WHEN d <= 2 THEN [0] WHEN 2 * (d - 2) = floor(2 * (d - 2)) THEN range(0, CAST(2 * (d - 2) AS BIGINT) + 1) ELSE range(0, CAST(floor(2 * (d - 2)) AS BIGINT) + 2) END) AS s
    FROM (SELECT conv_id, turn, length(text) / 20.0 AS d FROM conversations))""")
def math_windows(t, spark):
    from tallyfield.operators.sequences import sliding_spans

    rows = t("conversations").select("conv_id", "turn", (F.length("text") / 20.0).alias("d"))
    return sliding_spans(rows, "d", 2.0, 0.5).select("conv_id", "turn", "start_s", "end_s")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0")
def math_isfinite(t, spark):
    bad = F.when(F.col("vec_id") % 7 == 0, F.concat("embedding", F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    return t("embeddings").filter(V.is_finite(bad)).select("vec_id")


@query("SELECT doc_id, sha256(text) AS checksum FROM documents")
def hash_sha256(t, spark):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("checksum"))


@query("SELECT count(*) AS n, count(*) AS ids, true AS shaped FROM nation")
def id_run(t, spark):
    rid = F.concat_ws("-", F.lit("agent"), F.date_format(F.lit("2024-01-01 00:00:00").cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'"), F.substring(F.uuid(), 1, 8))
    return t("nation").select(rid.alias("id")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.bool_and(F.col("id").rlike(r"^agent-\d{8}T\d{6}Z-[0-9a-f]{8}$")).alias("shaped"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_get(t, spark):
    return t("events").select("event_id", J.first_of("props", "key", "k").try_cast("int").alias("k"))


@query("SELECT event_id, event_id % 2 = 0 AS has FROM events")
def json_has(t, spark):
    j = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise('{"other": {"k": 1}}')
    return t("events").select("event_id", J.has(j, "k").alias("has"))


@query("""SELECT event_id, '{"id":' || event_id || '}' AS j FROM events""")
def json_del(t, spark):
    j = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "k": {"a": [1, 2]}}'))
    return t("events").select("event_id", J.without(j, "k").alias("j"))


@query("""SELECT event_id, '{"k":' || (CASE WHEN event_id % 2 = 0 THEN '{"n":[' || event_id || ']}' ELSE json_extract_string(props, '$.k') END) || ',"t":"' || event_type || '"}' AS j FROM events""")
def json_merge(t, spark):
    patch = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"k": {"n": ['), F.col("event_id").cast("string"), F.lit("]}}"))).otherwise("{}")
    base = F.concat(F.lit('{"t": "'), "event_type", F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return t("events").select("event_id", J.merged(base, patch).alias("j"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '{"name":"' || s_name || '","key":' || s_suppkey || '}' ELSE '{"key":' || s_suppkey || '}' END AS j FROM supplier""")
def json_build(t, spark):
    return t("supplier").select("s_suppkey", F.to_json(F.struct(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), F.col("s_suppkey").alias("key"))).alias("j"))


@query("SELECT event_id, event_id % 2 = 0 AS same FROM events")
def json_eq(t, spark):
    k = F.get_json_object("props", "$.k")
    a = F.concat(F.lit('{"a": 1, "k": '), k, F.lit("}"))
    b = F.concat(F.lit('{"k": '), k, F.lit(', "a": '), F.when(F.col("event_id") % 2 == 0, "1").otherwise("2"), F.lit("}"))
    return t("events").select("event_id", J.same(a, b).alias("same"))


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_partkey FROM lineitem")
def json_flatten(t, spark):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: F.struct(x["l_partkey"].alias("part"))).alias("lines"))).alias("j"))
    parsed = lines.select("l_orderkey", F.from_json("j", "lines array<struct<part:bigint>>").alias("p"))
    return parsed.select("l_orderkey", F.posexplode_outer("p.lines").alias("pos", "x")).select("l_orderkey", F.col("pos").cast("long").alias("pos"), F.col("x.part").alias("l_partkey"))


@query("SELECT o_orderkey, side, v FROM (SELECT o_orderkey, 'home' AS side, o_custkey AS v FROM orders UNION ALL SELECT o_orderkey, 'away', o_orderkey FROM orders)")
def json_two_sides(t, spark):
    sides = F.array(F.struct(F.lit("home").alias("side"), F.col("o_custkey").alias("v")), F.struct(F.lit("away").alias("side"), F.col("o_orderkey").alias("v")))
    return t("orders").select("o_orderkey", F.explode(sides).alias("s")).select("o_orderkey", "s.*")


RENAMES = {"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance"}


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def json_rename(t, spark):
    return t("supplier").select([F.col(a).alias(b) for a, b in RENAMES.items()])


@query("""SELECT doc_id, '{"deep_keys": ["a"], "doc_id": ' || doc_id || coalesce(', "lang": "' || lang || '"', '') || coalesce(', "words_count": ' || least(5, len(string_split(text, ' '))), '') || '}' AS summary FROM documents""")
def json_summarise(t, spark):
    from tallyfield.functions.summaries import summarise

    j = F.to_json(F.struct("doc_id", "lang", F.slice(F.split("text", " "), 1, 5).alias("words"), F.create_map(F.lit("a"), F.create_map(F.lit("b"), F.col("n_chars"))).alias("deep")))
    return t("documents").select("doc_id", summarise(j).alias("summary"))


@query("SELECT doc_id, unnest(string_split(text, ' ')[1:5]) AS word FROM documents")
def arr_unnest(t, spark):
    return t("documents").select("doc_id", F.explode(F.slice(F.split("text", " ", -1), 1, 5)).alias("word"))


@query("SELECT o_custkey, md5(array_to_string(list(o_orderkey ORDER BY o_orderkey), ',')) AS h FROM orders GROUP BY 1")
def arr_sort(t, spark):
    return t("orders").groupBy("o_custkey").agg(F.md5(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",")).alias("h"))


@query("SELECT doc_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS head FROM documents")
def arr_slice(t, spark):
    return t("documents").select("doc_id", F.array_join(F.slice(F.split("text", " ", -1), 1, 4), " ").alias("head"))


@query("SELECT doc_id, len(list_filter(list_distinct(string_split(text, ' ')), lambda x: NOT list_contains(['the', 'of', 'and'], x))) AS n FROM documents")
def arr_except(t, spark):
    return t("documents").select("doc_id", F.size(F.array_except(F.split("text", " ", -1), F.array(F.lit("the"), F.lit("of"), F.lit("and")))).cast("long").alias("n"))


@query("SELECT doc_id, len(list_distinct(list_concat(string_split(text, ' '), ['the', lang]))) AS n FROM documents")
def arr_set(t, spark):
    return t("documents").select("doc_id", F.size(F.array_union(F.split("text", " ", -1), F.array(F.lit("the"), F.col("lang")))).cast("long").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(round(p_retailprice) AS BIGINT) END AS v FROM part")
def num_unit_value(t, spark):
    unit = F.when(F.col("p_partkey") % 2 == 0, "CMT").otherwise("KGM")
    return t("part").select("p_partkey", N.unit_value(F.col("p_retailprice").cast("string"), unit, "CMT").alias("v"))


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(strip_accents(trim(text))), '[''\".]', '', 'g'), '\\s+', '-', 'g') AS slug FROM documents WHERE lang IN ('fr', 'es')".replace("\\\\", "\\"))
def str_slug_fold(t, spark):
    return t("documents").filter(F.col("lang").isin("fr", "es")).select("doc_id", X.slug_fold("text").alias("slug"))


@query("SELECT doc_id, len(list_filter(list_filter(string_split(lower(text), ' ')[1:3], lambda w: length(w) >= 3), lambda w: NOT contains(lower(text), w))) = 0 AS found FROM documents")
def evidence_check(t, spark):
    name = F.filter(F.slice(F.split(F.lower("text"), " ", -1), 1, 3), lambda w: F.length(w) >= 3)
    return t("documents").select("doc_id", F.forall(name, lambda w: F.contains(F.lower("text"), w)).alias("found"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\bsell') THEN 'sell' WHEN regexp_matches(text, '(?i)the .*of') THEN 'buy' WHEN regexp_matches(text, '(?i) la ') THEN 'avoid' ELSE 'hold' END AS call FROM documents".replace("\\\\", "\\"))
def classify_first_match(t, spark):
    rules = [(r"(?i)\bsell", "sell"), (r"(?i)the .*of", "buy"), ("(?i) la ", "avoid")]
    from tallyfield.functions.scoring import ladder

    return t("documents").select("doc_id", ladder([(F.col("text").rlike(p), v) for p, v in rules], "hold").alias("call"))
