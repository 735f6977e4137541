"""Rows out of payloads, candidate lists, guarded inserts and text blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.functions import json_fns as J
from tallyfield.functions import text as X
from tallyfield.operators import sequences as Q
from tallyfield.operators.windows import top_per_key

from .registry import query


@query("""SELECT 'customer' AS kind, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal FROM supplier UNION ALL SELECT 'part', p_name, NULL FROM part""")
def union_heterogeneous(t, spark):
    kind = lambda name, df, n, b: df.select(F.lit(name).alias("kind"), F.col(n).alias("name"), (F.col(b) if b else F.lit(None).cast("double")).alias("balance"))
    return kind("customer", t("customer"), "c_name", "c_acctbal").unionByName(kind("supplier", t("supplier"), "s_name", "s_acctbal")).unionByName(kind("part", t("part"), "p_name", None))


@query("""SELECT o_orderkey, home, away, CASE WHEN hs IS NOT NULL AND aws IS NOT NULL THEN hs END AS home_score, CASE WHEN hs IS NOT NULL AND aws IS NOT NULL THEN aws END AS away_score, nullif(att, 0) AS attendance FROM
    (SELECT o_orderkey, o_custkey % 17 AS home, o_orderkey % 17 AS away, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS hs, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS aws, o_orderkey % 10 AS att FROM orders) WHERE home <> away""")
def extract_match(t, spark):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    payload = F.to_json(F.struct((c % 17).alias("home"), (k % 17).alias("away"), F.when(k % 3 != 0, c).alias("hs"), F.when(k % 5 != 0, k).alias("as"), (k % 10).alias("att")))
    p = t("orders").select("o_orderkey", F.from_json(payload, "home bigint, away bigint, hs bigint, `as` bigint, att bigint").alias("p"))
    both = F.col("p.hs").isNotNull() & F.col("p.as").isNotNull()
    rows = p.filter(F.col("p.home").isNotNull() & (F.col("p.home") != F.col("p.away")))
    return rows.select("o_orderkey", F.col("p.home").alias("home"), F.col("p.away").alias("away"), F.when(both, F.col("p.hs")).alias("home_score"), F.when(both, F.col("p.as")).alias("away_score"), F.nullif(F.col("p.att"), F.lit(0)).alias("attendance"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '/([a-z]{2})/\d+', 1), ''), printf('%s-v-%s-r%02d-%d', 'home', 'away', page_id % 30, 2024)) AS id FROM pages""")
def extract_fixture(t, spark):
    found = F.nullif(F.regexp_extract("url", r"/([a-z]{2})/\d+", 1), F.lit(""))
    made = F.format_string("%s-v-%s-r%02d-%d", F.lit("home"), F.lit("away"), F.col("page_id") % 30, F.lit(2024))
    return t("pages").select("page_id", F.coalesce(found, made).alias("id"))


@query("SELECT conv_id, turn, role, turn = (conv_id % 3) AS captain FROM conversations")
def extract_team_list(t, spark):
    rosters = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("roster"), F.first(F.col("conv_id") % 3).alias("cap"))
    return rosters.select("conv_id", "cap", F.explode("roster").alias("r")).select("conv_id", "r.turn", "r.role", (F.col("r.turn") == F.col("cap")).alias("captain"))


@query(r"""SELECT event_id, name, CAST(k AS INTEGER) AS rounds FROM (SELECT event_id, trim(CASE WHEN event_id % 4 = 0 THEN '  ' ELSE event_type END) AS name, regexp_extract('out for ' || json_extract_string(props, '$.k') || ' rounds', '(\d+) rounds', 1) AS k FROM events) WHERE name <> ''""")
def extract_injury(t, spark):
    note = F.concat(F.lit("out for "), F.get_json_object("props", "$.k"), F.lit(" rounds"))
    rows = t("events").select("event_id", F.trim(F.when(F.col("event_id") % 4 == 0, "  ").otherwise(F.col("event_type"))).alias("name"), F.regexp_extract(note, r"(\d+) rounds", 1).try_cast("int").alias("rounds"))
    return rows.filter("name <> ''")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'fallback' ELSE c_name END AS name, nullif(CAST(c_custkey % 4 AS INTEGER), 0) AS minutes FROM customer WHERE c_custkey % 6 <> 0 OR c_custkey % 3 = 0""")
def extract_grid(t, spark):
    a = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name"))
    b = F.when(F.col("c_custkey") % 3 == 0, "<b>fallback</b>").otherwise("")
    name = F.coalesce(F.nullif(F.trim(a), F.lit("")), F.nullif(X.clean_html(b), F.lit("")))
    return t("customer").select("c_custkey", name.alias("name"), F.nullif((F.col("c_custkey") % 4).cast("int"), F.lit(0)).alias("minutes")).filter("name IS NOT NULL")


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages".replace('\\"', '"'))
def html_jsonld(t, spark):
    wrapped = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("Page").alias("@type"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))), F.lit("</script>"))
    found = F.regexp_extract(wrapped, r'(?s)<script[^>]*ld\+json[^>]*>(.*?)</script>', 1)
    rows = t("pages").select("page_id", found.alias("j")).filter(F.get_json_object("j", "$['@type']") == "Page")
    return rows.select("page_id", J.first_of("j", "name").alias("title"), J.first_of("j", "lang").alias("lang"))


@query("""SELECT p_partkey, a || '|' || b AS candidates FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part)""")
def gen_candidates(t, spark):
    parts = F.split("p_name", " ")
    variants = F.array_distinct(F.array("p_name", parts[0], F.element_at(parts, -1), F.element_at(parts, -1)))
    return t("part").select("p_partkey", F.array_join(F.array_remove(variants, F.col("p_name")), "|").alias("candidates"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def set_missing_keys(t, spark):
    return t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT printf('%d/%02d', s, r) AS key FROM range(1990, 2000) a(s), range(1, 28) b(r) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE year(o_orderdate) = s AND weekofyear(o_orderdate) = r AND o_orderkey % 50 = 0)")
def resume_expected(t, spark):
    keys = spark.range(1990, 2000).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(1), F.lit(27))).alias("r"))
    have = t("orders").filter("o_orderkey % 50 = 0").select(F.year("o_orderdate").cast("long").alias("s"), F.weekofyear("o_orderdate").alias("r"))
    return keys.join(have, ["s", "r"], "left_anti").select(F.format_string("%d/%02d", "s", "r").alias("key"))


@query("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'id taken' WHEN s_suppkey % 3 = 0 THEN 'slug taken' ELSE 'inserted' END AS outcome FROM supplier) GROUP BY 1""")
def insert_guarded(t, spark):
    s = t("supplier").select(F.col("s_suppkey").alias("id"), X.slug("s_name").alias("slug"))
    ids, slugs = s.filter("id % 2 = 0").select("id", F.lit(True).alias("has_id")), s.filter("id % 3 = 0").select("slug", F.lit(True).alias("has_slug"))
    out = s.join(ids, "id", "left").join(slugs, "slug", "left")
    return out.groupBy(F.when(F.col("has_id"), "id taken").when(F.col("has_slug"), "slug taken").otherwise("inserted").alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) THEN 'primary' ELSE 'secondary' END AS pool FROM customer""")
def pool_scope(t, spark):
    active = t("events").select(F.col("user_id").alias("c_custkey")).distinct()
    c = t("customer").select("c_custkey")
    return c.join(active, "c_custkey", "left_semi").withColumn("pool", F.lit("primary")).unionByName(c.join(active, "c_custkey", "left_anti").withColumn("pool", F.lit("secondary")))


@query(r"SELECT page_id, n_name FROM (SELECT page_id, try_cast(regexp_extract(url, '/(\d+)', 1) AS INTEGER) % 25 AS r FROM pages) JOIN nation ON r = n_nationkey")
def round_from_title(t, spark):
    rows = t("pages").select("page_id", (F.regexp_extract("url", r"/(\d+)", 1).try_cast("int") % 25).alias("n_nationkey"))
    return rows.join(t("nation"), "n_nationkey").select("page_id", "n_name")


@query("""SELECT a.conv_id, a.turn, a.text AS raw, b.text AS clean FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) a
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE turn < 2) b ON a.conv_id = b.conv_id AND a.p = b.p""")
def chunk_align(t, spark):
    lists = lambda rows, n: rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias(n))
    both = lists(t("conversations"), "a").join(lists(t("conversations").filter("turn < 2"), "b"), "conv_id", "left")
    rows = both.select("conv_id", "b", F.posexplode("a").alias("p", "r"))
    return rows.select("conv_id", "r.turn", F.col("r.text").alias("raw"), F.try_element_at("b", F.col("p") + 1)["text"].alias("clean"))


@query("""SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20)) WHERE rn <= 15 GROUP BY 1""")
def article_context(t, spark):
    top = t("customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select(F.col("c_custkey").alias("o_custkey"))
    rows = top_per_key(t("orders").join(F.broadcast(top), "o_custkey"), ["o_custkey"], 15, "o_orderkey")
    return rows.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("ids"), F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT doc_id // 100 AS page FROM documents), e AS (SELECT min(page) + 1 AS gap FROM p WHERE page + 1 NOT IN (SELECT page FROM p))
    SELECT doc_id, n_chars FROM documents, e WHERE doc_id // 100 < gap""")
def page_union(t, spark):
    # pages of 100 ids, one after another, until the first one without rows
    rows = t("documents").select("doc_id", "n_chars", F.expr("doc_id div 100").alias("page"))
    pages = rows.select("page").distinct()
    gap = pages.join(pages.select((F.col("page") - 1).alias("page")), "page", "left_anti").agg((F.min("page") + 1).alias("gap"))
    return rows.join(gap, F.col("page") < F.col("gap")).select("doc_id", "n_chars")


@query("""SELECT doc_id, turn, chunk FROM (SELECT doc_id, doc_id % 3 AS turn, unnest([doc_id * 10, doc_id * 10 + 1]) AS chunk FROM labels)""")
def chunk_links(t, spark):
    rows = t("labels").select("doc_id", F.array(F.col("doc_id") * 10, F.col("doc_id") * 10 + 1).alias("chunks"))
    return rows.select("doc_id", (F.col("doc_id") % 3).alias("turn"), F.posexplode("chunks").alias("ordinal", "chunk")).drop("ordinal")


@query("""SELECT p_partkey, CASE WHEN rn = 1 THEN s ELSE s || '-' || rn END AS slug FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS rn FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS s FROM part))""")
def slug_unique(t, spark):
    rows = t("part").select("p_partkey", X.slug("p_name").alias("s"))
    rn = F.row_number().over(Window.partitionBy("s").orderBy("p_partkey"))
    return rows.withColumn("rn", rn).select("p_partkey", F.when(F.col("rn") == 1, F.col("s")).otherwise(F.concat_ws("-", "s", F.col("rn").cast("string"))).alias("slug"))


@query("""SELECT user_id, CASE WHEN user_id <= 0 THEN 'error' WHEN c.c_custkey IS NOT NULL THEN 'dimension' WHEN s.s_suppkey IS NOT NULL THEN 'source' ELSE 'unknown' END AS verdict FROM (SELECT DISTINCT user_id FROM events) e
    LEFT JOIN customer c ON c.c_custkey = user_id AND c.c_custkey % 2 = 0 LEFT JOIN supplier s ON s.s_suppkey = user_id""")
def cascade_verdict(t, spark):
    from tallyfield.operators.joins import cascade

    users = t("events").select("user_id").distinct()
    dims = t("customer").filter("c_custkey % 2 = 0").select("c_custkey", F.lit("dimension").alias("v"))
    out = cascade(users, [(dims, "user_id", "c_custkey", "v"), (t("supplier").select("s_suppkey", F.lit("source").alias("v")), "user_id", "s_suppkey", "v")], "hit")
    return out.select("user_id", F.when(F.col("user_id") <= 0, "error").otherwise(F.coalesce("hit", F.lit("unknown"))).alias("verdict"))


@query("""SELECT kind, id FROM ((SELECT 'customer' AS kind, c_custkey AS id FROM customer ORDER BY c_custkey LIMIT 30) UNION ALL (SELECT 'supplier', s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 20))
    UNION ALL SELECT 'more', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) - 30 - least(20, (SELECT count(*) FROM supplier))""")
def budgeted_list(t, spark):
    budget = 50
    first = t("customer").orderBy("c_custkey").limit(30).select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    left = budget - first.count()
    second = t("supplier").orderBy("s_suppkey").limit(left).select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))
    shown = first.unionByName(second)
    total = t("customer").count() + t("supplier").count()
    return shown.unionByName(shown.agg(F.count("*").alias("n")).select(F.lit("more").alias("kind"), (F.lit(total) - F.col("n")).alias("id")))


@query("""SELECT c_custkey, '# ' || c_name || chr(10) || coalesce('Balance: ' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'No segment') || chr(10) || left(repeat(c_mktsegment, 40), 280) AS body FROM customer""")
def text_template(t, spark):
    segment = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    lines = [F.concat(F.lit("# "), "c_name"), F.coalesce(F.concat(F.lit("Balance: "), segment), F.lit("No segment")), F.left(F.repeat("c_mktsegment", 40), F.lit(280))]
    return t("customer").select("c_custkey", F.concat_ws("\n", *lines).alias("body"))


@query("""SELECT o_custkey, 'Customer ' || o_custkey || ': ' || n || ' orders; ' || q AS text FROM (SELECT o_custkey, count(*) AS n, array_to_string(list('#' || o_orderkey ORDER BY o_orderkey)[1:3], ', ') AS q FROM orders GROUP BY 1)""")
def ctx_text(t, spark):
    per = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 3).alias("ids"))
    quotes = F.array_join(F.transform("ids", lambda x: F.concat(F.lit("#"), x.cast("string"))), ", ")
    return per.select("o_custkey", F.concat(F.format_string("Customer %d: %d orders; ", "o_custkey", "n"), quotes).alias("text"))


CLAIM_TOKENS = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 3)"


@query(f"""WITH k AS (SELECT conv_id, {CLAIM_TOKENS.format('arg_max(text, turn)')} AS k FROM conversations GROUP BY 1),
    c AS (SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: list_contains(k, x))) / len(w) END AS coverage FROM (SELECT conv_id, turn, {CLAIM_TOKENS.format('text')} AS w FROM conversations) JOIN k USING (conv_id)),
    h AS (SELECT *, sum(CASE WHEN turn - p <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c WHERE coverage >= 0.4)),
    r AS (SELECT conv_id, run, min(turn) AS first_pos, max(turn) AS last_pos, round(sum(coverage), 9) AS score FROM h GROUP BY 1, 2),
    b AS (SELECT conv_id, first_pos, last_pos FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, first_pos) AS rn FROM r WHERE score >= 1) WHERE rn = 1),
    l AS (SELECT v.conv_id, v.turn, row_number() OVER (PARTITION BY v.conv_id ORDER BY v.turn) - 1 AS ordinal, first_pos, last_pos FROM conversations v JOIN b ON v.conv_id = b.conv_id AND v.turn BETWEEN first_pos AND last_pos)
    SELECT k.conv_id AS claim_id, coalesce(cu.c_name, s.s_name) AS entity, first_pos AS start_pos, last_pos AS end_pos, turn AS chunk, ordinal FROM k LEFT JOIN l ON l.conv_id = k.conv_id
    LEFT JOIN customer cu ON cu.c_custkey = k.conv_id AND cu.c_custkey % 2 = 1 LEFT JOIN supplier s ON s.s_suppkey = k.conv_id % 10""")
def ingest_claims(t, spark):
    """A claim for each conversation, its last turn: its subject, the run of chunks it draws on, their span, and a link to each chunk."""
    from tallyfield.operators.joins import cascade

    chunks = t("conversations").select("conv_id", "turn", X.tokens("text").alias("w"))
    claims = t("conversations").groupBy("conv_id").agg(X.tokens(F.max_by("text", "turn")).alias("k"))
    covered = chunks.join(claims, "conv_id").select("conv_id", "turn", X.coverage(F.col("w"), F.col("k")).alias("coverage"))
    runs = Q.find_run(covered, ["conv_id"], "turn", "coverage", 0.4, 1.0).select("conv_id", F.col("first_pos").alias("start_pos"), F.col("last_pos").alias("end_pos"))
    inside = chunks.select("conv_id", "turn").join(runs, "conv_id").filter("turn BETWEEN start_pos AND end_pos")
    links = inside.groupBy("conv_id", "start_pos", "end_pos").agg(F.array_sort(F.collect_list("turn")).alias("turns")).select("conv_id", "start_pos", "end_pos", F.posexplode("turns").alias("ordinal", "chunk"))
    steps = [(t("customer").filter("c_custkey % 2 = 1"), "conv_id", "c_custkey", "c_name"), (t("supplier"), "fallback", "s_suppkey", "s_name")]
    named = cascade(claims.select("conv_id", (F.col("conv_id") % 10).alias("fallback")), steps, "entity")
    return named.join(links, "conv_id", "left").select(F.col("conv_id").alias("claim_id"), "entity", "start_pos", "end_pos", "chunk", F.col("ordinal").cast("long").alias("ordinal"))


@query("SELECT a.turn AS pos, count(*) AS n, count(*) FILTER (WHERE a.text <> b.text) AS differ FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id + 1 AND a.turn = b.turn GROUP BY 1")
def cmp_transcript_diff(t, spark):
    a = t("conversations").select("conv_id", "turn", "text")
    b = a.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("text").alias("other"))
    return a.join(b, ["conv_id", "turn"]).groupBy(F.col("turn").alias("pos")).agg(F.count("*").alias("n"), F.count_if(F.col("text") != F.col("other")).alias("differ"))


@query("SELECT user_id, d, n FROM (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2) WHERE n >= 2")
def extract_daily(t, spark):
    return t("events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("n")).filter("n >= 2")
