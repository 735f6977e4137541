"""Clustering, smoothing, segmentation and retrieval on vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.functions import text as X
from tallyfield.functions import vectors as V
from tallyfield.operators import clustering as C
from tallyfield.operators import segments as S
from tallyfield.operators import sequences as Q
from tallyfield.operators.joins import asof_backward

from .registry import query


@query("""SELECT a.vec_id, a.label, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b WHERE a.vec_id <> 7 AND a.label <> 3
    ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, a.vec_id LIMIT 10""")
def vec_rag(t, spark):
    live = t("embeddings").select("vec_id", "label", V.doubles("embedding").alias("v"))
    probe = live.filter("vec_id = 7").select(F.col("v").alias("q"))
    scored = live.filter("vec_id <> 7 AND label <> 3").crossJoin(F.broadcast(probe)).withColumn("cos", V.cosine("v", "q"))
    return scored.orderBy(F.desc("cos"), "vec_id").limit(10).select("vec_id", "label", F.round("cos", 6).alias("score"))


@query("""SELECT DISTINCT c_custkey, c_name FROM customer JOIN (SELECT unnest([vec_id, label]) AS k FROM (SELECT a.vec_id, a.label FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b WHERE a.vec_id <> 7 AND a.label <> 3
    ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, a.vec_id LIMIT 10)) ON k = c_custkey""")
def vec_attrib(t, spark):
    ids = vec_rag(t, spark).select(F.explode(F.array("vec_id", F.col("label").cast("long"))).alias("c_custkey"))
    return t("customer").join(ids, "c_custkey", "left_semi").select("c_custkey", "c_name")


def sources(t):
    """Vectors in sources of 1,000 consecutive ids."""
    return t("embeddings").filter(V.is_finite("embedding")).select(F.expr("vec_id div 1000").alias("grp"), "vec_id", V.doubles("embedding").alias("v"))


@query()
def clu_density(t, spark):
    return C.density_clusters_of(sources(t), ["grp"], "vec_id", 8)


@query()
def clu_sampled(t, spark):
    # two large sources: density clusters of about 500 points of each, the nearest centroid for the others
    rows = sources(t).withColumn("grp", F.col("vec_id") % 2)
    return C.cluster_bounded(rows, ["grp"], "vec_id", 8, most=500)


@query("""WITH m AS (SELECT label, k, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE vec_id % 2 = 0) GROUP BY 1, 2),
    c AS (SELECT label, list(x ORDER BY k) AS centroid FROM m GROUP BY 1), s AS (SELECT vec_id, c.label AS cluster, list_cosine_similarity(e.embedding::DOUBLE[], centroid) AS sim FROM embeddings e, c WHERE vec_id % 2 = 1)
    SELECT vec_id, CASE WHEN max(sim) >= 0.25 THEN arg_max(cluster, sim) END AS cluster FROM s GROUP BY 1""")
def clu_assign(t, spark):
    rows = t("embeddings").select(F.lit(0).alias("g"), "vec_id", "label", V.doubles("embedding").alias("v"))
    means = V.centroids(rows.filter("vec_id % 2 = 0"), ["g", "label"], "v").withColumnRenamed("label", "cluster")
    return C.assign(rows.filter("vec_id % 2 = 1"), means, ["g"], "vec_id", 0.25).select("vec_id", "cluster")


def points_2d(t):
    return t("events").select("user_id", "event_id", F.col("value").alias("x"), (F.get_json_object("props", "$.k").cast("double") * 4).alias("y"))


#: One event after another: the nearest mean within 120 moves, or a new one begins.
ONLINE = """WITH RECURSIVE p AS (SELECT user_id, event_id, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 4 AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    r AS (SELECT user_id, event_id, rn, CAST(0 AS BIGINT) AS cluster, [x] AS mx, [y] AS my, [1] AS n FROM p WHERE rn = 1
    UNION ALL SELECT user_id, event_id, rn, CASE WHEN list_min(d) <= 120 THEN list_position(d, list_min(d)) - 1 ELSE len(mx) END,
    CASE WHEN list_min(d) <= 120 THEN list_transform(mx, lambda m, i: CASE WHEN i = list_position(d, list_min(d)) THEN m + (x - m) / (n[i] + 1) ELSE m END) ELSE list_append(mx, x) END,
    CASE WHEN list_min(d) <= 120 THEN list_transform(my, lambda m, i: CASE WHEN i = list_position(d, list_min(d)) THEN m + (y - m) / (n[i] + 1) ELSE m END) ELSE list_append(my, y) END,
    CASE WHEN list_min(d) <= 120 THEN list_transform(n, lambda m, i: CASE WHEN i = list_position(d, list_min(d)) THEN m + 1 ELSE m END) ELSE list_append(n, 1) END
    FROM (SELECT p.user_id, p.event_id, p.rn, x, y, mx, my, n, list_transform(mx, lambda m, i: sqrt((m - x) * (m - x) + (my[i] - y) * (my[i] - y))) AS d FROM r JOIN p ON p.user_id = r.user_id AND p.rn = r.rn + 1))"""


@query(ONLINE + " SELECT user_id, event_id, cluster FROM r")
def clu_greedy_online(t, spark):
    return C.online_clusters(points_2d(t), "user_id", "event_id", 120.0).select("user_id", "event_id", "cluster")


def merged_2d(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("cluster", kind="stable")
    return rows.assign(merged=C.merge_close(rows[["x", "y"]].to_numpy(float), rows["n"].to_numpy(), 100.0, 5))[["user_id", "cluster", "merged"]]


#: The closest pair of a user's clusters merges until none is within 100; members remember where they were.
MERGING = """,
    c AS (SELECT user_id, cluster, avg(x) AS x, avg(y) AS y, count(*) AS n FROM (SELECT r.user_id, r.cluster, p.x, p.y FROM r JOIN p ON p.user_id = r.user_id AND p.rn = r.rn) GROUP BY 1, 2),
    s AS (SELECT user_id, 0 AS step, list({'x': x, 'y': y, 'n': n, 'of': [cluster]} ORDER BY cluster) AS g FROM c GROUP BY 1
    UNION ALL SELECT user_id, step + 1, list_filter(list_transform(g, lambda o, k: CASE WHEN k = b.i THEN {'x': (o.x * o.n + g[b.j].x * g[b.j].n) / (o.n + g[b.j].n), 'y': (o.y * o.n + g[b.j].y * g[b.j].n) / (o.n + g[b.j].n), 'n': o.n + g[b.j].n, 'of': list_concat(o.of, g[b.j].of)} ELSE o END), lambda o, k: k <> b.j)
      FROM (SELECT *, list_sort(flatten(list_transform(g, lambda o, k: list_transform(range(k + 1, len(g) + 1), lambda j: {'d': sqrt((o.x - g[j].x) * (o.x - g[j].x) + (o.y - g[j].y) * (o.y - g[j].y)), 'i': k, 'j': j}))))[1] AS b FROM s) WHERE b.d <= 100),
    t AS (SELECT user_id, arg_max(g, step) AS g FROM s GROUP BY 1)"""


@query(ONLINE + MERGING + """ SELECT user_id, unnest(o.of) AS cluster, CASE WHEN o.n >= 5 THEN k - 1 ELSE -1 END AS merged FROM (SELECT user_id, unnest(g) AS o, generate_subscripts(g, 1) AS k FROM t)""")
def clu_merge(t, spark):
    found = C.online_clusters(points_2d(t), "user_id", "event_id", 120.0).filter("cluster IS NOT NULL")
    means = found.groupBy("user_id", "cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    return Q.grouped(means, ["user_id"], merged_2d, "user_id long, cluster long, merged long")


PAIRS = "SELECT user_id, event_type, hour(ts) % 7 AS grp, count(*) AS n FROM events GROUP BY 1, 2, 3"


def type_pairs(t):
    return t("events").groupBy("user_id", "event_type", (F.hour("ts") % 7).cast("long").alias("grp")).agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type, grp) AS rn FROM ({PAIRS})),
    r AS (SELECT user_id, event_type, grp, n, rn, true AS taken, [event_type] AS a, [grp] AS b FROM p WHERE rn = 1
    UNION ALL SELECT p.user_id, p.event_type, p.grp, p.n, p.rn, NOT list_contains(a, p.event_type) AND NOT list_contains(b, p.grp),
    CASE WHEN list_contains(a, p.event_type) OR list_contains(b, p.grp) THEN a ELSE list_append(a, p.event_type) END, CASE WHEN list_contains(a, p.event_type) OR list_contains(b, p.grp) THEN b ELSE list_append(b, p.grp) END
    FROM r JOIN p ON p.user_id = r.user_id AND p.rn = r.rn + 1)
    SELECT user_id, event_type, grp, n FROM r WHERE taken""")
def pair_greedy(t, spark):
    return C.pair_greedy(type_pairs(t), ["user_id"], "event_type", "grp", "n")


@query("SELECT event_type, arg_max(grp, n * 1000 - grp) AS grp FROM (SELECT event_type, user_id % 7 AS grp, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def pair_argmax(t, spark):
    pairs = t("events").groupBy("event_type", (F.col("user_id") % 7).alias("grp")).agg(F.count("*").alias("n"))
    return pairs.groupBy("event_type").agg(F.max_by("grp", F.struct("n", (-F.col("grp")).alias("o"))).alias("grp"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    i AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id, label ORDER BY rn) AS g FROM e),
    u AS (SELECT user_id, label, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY min(rn)) AS k FROM i GROUP BY user_id, label, g),
    r AS (SELECT user_id, 1 AS step, CAST(1 AS BIGINT) AS k, [label] AS l, [n] AS c FROM u WHERE k = 1
    UNION ALL SELECT q.user_id, step + 1, CASE WHEN fold THEN q.k ELSE q.k + 1 END, CASE WHEN fold THEN l[:-3] ELSE list_append(l, u.label) END, CASE WHEN fold THEN list_append(c[:-4], c[-3] + c[-2] + c[-1]) ELSE list_append(c, u.n) END
    FROM (SELECT *, len(l) >= 3 AND l[-3] = l[-1] AND c[-2] <= 1 AS fold FROM r) q LEFT JOIN u ON NOT fold AND u.user_id = q.user_id AND u.k = q.k + 1 WHERE fold OR u.k IS NOT NULL),
    f AS (SELECT user_id, arg_max(l, step) AS l, arg_max(c, step) AS c FROM r GROUP BY 1), x AS (SELECT user_id, unnest(l) AS label, unnest(c) AS n, generate_subscripts(l, 1) AS i FROM f),
    y AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY i) AS hi FROM x)
    SELECT e.user_id, e.event_id, y.label FROM e JOIN y ON e.user_id = y.user_id AND e.rn <= y.hi AND e.rn > y.hi - y.n""")
def seg_smooth_runs(t, spark):
    rows = t("events").select("user_id", "ts", "event_id", F.col("event_type").alias("label"))
    return Q.smoothed(rows, "user_id", ["ts", "event_id"], "label", 1).select("user_id", "event_id", "label")


@query("""WITH RECURSIVE p AS (SELECT conv_id, role, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) / 10.0 AS e, length(text) / 10.0 AS d, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
    q AS (SELECT conv_id, rn, role, e - d AS s, e, text FROM p),
    r AS (SELECT conv_id, rn, [{'role': role, 's': s, 'e': e, 'text': text}] AS l FROM q WHERE rn = 1
    UNION ALL SELECT q.conv_id, q.rn, CASE WHEN len(l) >= 2 AND l[-2].role = q.role AND l[-1].role <> q.role AND l[-1].e - l[-1].s < 15 AND l[-1].s - l[-2].e <= 1 AND q.s - l[-1].e <= 1
    THEN list_append(l[:-3], {'role': q.role, 's': l[-2].s, 'e': q.e, 'text': array_to_string(list_filter([l[-2].text, l[-1].text, q.text], lambda x: x <> ''), ' ')}) ELSE list_append(l, {'role': q.role, 's': q.s, 'e': q.e, 'text': q.text}) END
    FROM r JOIN q ON q.conv_id = r.conv_id AND q.rn = r.rn + 1),
    f AS (SELECT conv_id, unnest(arg_max(l, rn)) AS x FROM r GROUP BY 1) SELECT conv_id, x.role AS role, x.s AS s, x.e AS e, x.text AS text FROM f""")
def seg_smooth_text(t, spark):
    def smooth(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("turn", kind="stable")
        out = Q.smooth_spans(list(zip(rows["role"], rows["s"], rows["e"], rows["text"], strict=True)), 15.0, 1.0)
        return pd.DataFrame([(rows["conv_id"].iloc[0], *r) for r in out], columns=["conv_id", "role", "s", "e", "text"])

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text")).over(w) / 10.0
    rows = t("conversations").withColumn("e", end).withColumn("s", F.col("e") - F.length("text") / 10.0)
    return Q.grouped(rows, ["conv_id"], smooth, "conv_id long, role string, s double, e double, text string")


#: Phrases that begin another topic.
MOVES = ("next up", "moving on", "turning to", "on another note", "to begin with", "let us look at")
#: The dictionaries: nouns of parts' names are topics, their adjectives scopes.
NOUNS, ADJECTIVES = ("(SELECT list(DISTINCT string_split(p_name, ' ')[{}] ORDER BY string_split(p_name, ' ')[{}]) FROM part WHERE p_name IS NOT NULL)".format(k, k) for k in (2, 1))


def blocks(t, merge: bool):
    part = lambda k: S.names_of(t("part").select(F.split("p_name", " ")[k].alias("name")), "name")
    return S.topic_blocks(t("documents"), part(1), part(0), list(MOVES), merge=merge)


#: Sentences with their scores, peaks, and boundaries kept one after another.
BOUNDARIES = f"""WITH RECURSIVE v AS (SELECT {NOUNS} AS nouns, {ADJECTIVES} AS adjectives),
    d AS (SELECT doc_id, string_split_regex(text, '\\.[ \t\n\f\r]') AS ss, list_prepend('', regexp_extract_all(text, '\\.([ \t\n\f\r])', 1)) AS sep FROM documents WHERE text IS NOT NULL),
    a AS (SELECT doc_id, len(ss) AS n, generate_subscripts(ss, 1) - 1 AS pos, lower(unnest(ss)) AS s, unnest(sep) AS before FROM d),
    b AS (SELECT doc_id, n, pos, s, before, list_filter(nouns, lambda w: contains(s, w)) AS names, list_filter(adjectives, lambda w: contains(s, w)) AS scopes FROM a, v),
    c AS (SELECT *, coalesce(flatten(list(names) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), []) AS recent FROM b),
    e AS (SELECT doc_id, n, pos, CASE WHEN regexp_matches(s, '\\b({"|".join(MOVES)})\\b') THEN 2.0 ELSE 0.0 END + CASE WHEN before = chr(10) THEN 1.5 ELSE 0.0 END + len(list_filter(names, lambda x: NOT list_contains(recent, x))) AS score FROM c),
    f AS (SELECT *, max(score) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS m FROM e),
    g AS (SELECT doc_id, pos, score, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM f WHERE score >= 2 AND score = m AND pos >= 8 AND n - pos >= 8),
    r AS (SELECT doc_id, rn, [pos] AS kept, score AS last FROM g WHERE rn = 1
    UNION ALL SELECT g.doc_id, g.rn, CASE WHEN g.pos - kept[-1] >= 8 THEN list_append(kept, g.pos) WHEN g.score > last THEN list_append(kept[:-2], g.pos) ELSE kept END, CASE WHEN g.pos - kept[-1] >= 8 OR g.score > last THEN g.score ELSE last END
    FROM r JOIN g ON g.doc_id = r.doc_id AND g.rn = r.rn + 1),
    k AS (SELECT doc_id, arg_max(kept, rn) AS kept FROM r GROUP BY 1),
    z AS (SELECT d.doc_id, list_append(list_prepend(0, coalesce(kept, [])), len(ss)) AS cuts FROM d LEFT JOIN k ON d.doc_id = k.doc_id),
    y AS (SELECT doc_id, unnest(cuts[:-2]) AS a, unnest(cuts[2:]) - 1 AS z FROM z)"""

#: Blocks with the sentences of each topic and scope; a pass takes the next block in each step, and another one follows while blocks are joined.
MERGED = """,
    w AS (SELECT y.doc_id, a, z, list_transform(any_value(nouns), lambda x: (len(list_filter(flatten(list(names)), lambda w: w = x)))::BIGINT) AS t, list_transform(any_value(adjectives), lambda x: (len(list_filter(flatten(list(scopes)), lambda w: w = x)))::BIGINT) AS s
      FROM y JOIN b ON b.doc_id = y.doc_id AND b.pos BETWEEN a AND z, v GROUP BY y.doc_id, a, z),
    l AS (SELECT doc_id, list({'a': a, 'z': z, 't': t, 's': s} ORDER BY a) AS rest FROM w GROUP BY 1),
    q AS (SELECT doc_id, 0 AS step, rest[:0] AS done, rest, len(rest) + 1 AS before FROM l
    UNION ALL SELECT doc_id, step + 1, CASE WHEN len(rest) = 0 THEN rest WHEN joins THEN list_append(done[:-2], {'a': p.a, 'z': n.z, 't': list_transform(p.t, lambda x, i: x + n.t[i]), 's': list_transform(p.s, lambda x, i: x + n.s[i])}) ELSE list_append(done, n) END,
      CASE WHEN len(rest) = 0 THEN done ELSE rest[2:] END, CASE WHEN len(rest) = 0 THEN len(done) ELSE before END
      FROM (SELECT *, p IS NOT NULL AND least(p.z - p.a, n.z - n.a) + 1 < 80 AND len(list_filter(p.t, lambda x, i: x >= CASE WHEN p.z - p.a + 1 < 50 THEN 1 ELSE 2 END AND n.t[i] >= CASE WHEN n.z - n.a + 1 < 50 THEN 1 ELSE 2 END))
        >= CASE WHEN len(list_filter([p, n], lambda o: len(list_filter(o.t, lambda x: x >= 2)) >= 2 OR len(list_filter(o.t, lambda x: x >= 2)) = 1 AND len(list_filter(o.s, lambda x: x >= 3)) = 0)) > 0 THEN 1 ELSE 2 END AS joins
        FROM (SELECT *, done[-1] AS p, rest[1] AS n FROM q) WHERE len(rest) > 0 OR len(done) < before)),
    u AS (SELECT doc_id, unnest(arg_max(done, step)) AS o FROM q WHERE len(rest) = 0 GROUP BY 1),
    h AS (SELECT doc_id, o.a AS a, o.z AS z, list_transform(list_reverse_sort(list_filter(list_transform(o.t, lambda x, i: {'n': x, 'o': -i}), lambda x: x.n >= 2)), lambda x: nouns[-x.o]) AS top, list_filter(adjectives, lambda x, i: o.s[i] >= 3) AS wide FROM u, v)"""


@query(BOUNDARIES + " SELECT doc_id, a AS first_pos, z AS last_pos FROM y")
def seg_boundaries(t, spark):
    return blocks(t, merge=False).select("doc_id", "first_pos", "last_pos")


@query(BOUNDARIES + MERGED + """ SELECT doc_id, CASE WHEN len(top) >= 2 THEN 'versus' WHEN len(wide) >= 4 THEN 'general' WHEN len(wide) > 0 THEN 'scope' WHEN len(top) = 1 THEN 'single' ELSE 'general' END AS kind,
    CASE WHEN len(top) >= 2 THEN top[1] || ' vs ' || top[2] || CASE WHEN len(top) > 2 THEN ' (+' || (len(top) - 2) || ' more)' ELSE '' END WHEN len(wide) >= 4 THEN 'general' WHEN len(wide) > 0 THEN array_to_string(wide, '/') WHEN len(top) = 1 THEN top[1] ELSE 'general' END AS label,
    a AS first_pos, z AS last_pos FROM h""")
def seg_blocks(t, spark):
    return blocks(t, merge=True)


@query("""SELECT e.event_id, v.event_id AS frame_id, CASE WHEN v.value >= 4.5 THEN v.event_type END AS speaker FROM (SELECT * FROM events WHERE event_id % 4 = 0) e ASOF LEFT JOIN (SELECT * FROM events WHERE event_id % 4 <> 0) v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def seg_word_attribution(t, spark):
    frames = t("events").filter("event_id % 4 <> 0").select("user_id", "ts", F.col("event_id").alias("frame_id"), F.col("event_type").alias("face"), F.col("value").alias("motion"))
    words = t("events").filter("event_id % 4 = 0").select("event_id", "user_id", "ts")
    out = asof_backward(words, frames, ["user_id"], "ts", "ts", ["frame_id", "face", "motion"], ["frame_id"])
    return out.select("event_id", "frame_id", F.when(F.col("motion") >= 4.5, F.col("face")).alias("speaker"))


@query("""WITH m AS (SELECT conv_id, role, max(length(text)) AS n, list(DISTINCT turn) AS turns FROM conversations GROUP BY 1, 2),
    f AS (SELECT conv_id, role, n, turns, min(turn) AS first FROM conversations JOIN m USING (conv_id, role) WHERE length(text) = n GROUP BY ALL)
    SELECT conv_id, c.turn, role, text, array_to_string(list_sort(list_filter(turns, lambda x: x <> c.turn)), ',') AS also_in FROM conversations c JOIN f USING (conv_id, role) WHERE c.turn = first AND length(text) = n""")
def dedup_cross_group(t, spark):
    kept = Q.keep_longer(t("conversations").select("conv_id", "turn", "role", "text"), ["conv_id", "role"], "turn", "text")
    return kept.select("conv_id", "turn", "role", "text", F.array_join(F.col("also_in").cast("array<string>"), ",").alias("also_in"))


TOKENS = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 3)"


@query(f"""WITH k AS (SELECT doc_id, {TOKENS.format('text')} AS k FROM documents),
    c AS (SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: list_contains(k, x))) / len(w) END AS coverage FROM (SELECT conv_id, turn, {TOKENS.format('text')} AS w FROM conversations) JOIN k ON doc_id = conv_id),
    h AS (SELECT *, sum(CASE WHEN turn - p <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c WHERE coverage >= 0.4)),
    r AS (SELECT conv_id, run, min(turn) AS first_pos, max(turn) AS last_pos, round(sum(coverage), 9) AS score FROM h GROUP BY 1, 2)
    SELECT conv_id, first_pos, last_pos, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, first_pos) AS rn FROM r WHERE score >= 1) WHERE rn = 1""")
def str_find_run(t, spark):
    # each conversation's chunks against the text of its document
    known = t("documents").select(F.col("doc_id").alias("conv_id"), F.array_distinct(X.tokens("text")).alias("k"))
    chunks = t("conversations").join(known, "conv_id").select("conv_id", "turn", X.coverage(X.tokens("text"), F.col("k")).alias("coverage"))
    return Q.find_run(chunks, ["conv_id"], "turn", "coverage", 0.4, 1.0)
