"""The contract queries of the training-text operators: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, divergence, language_id, lm_scoring, packing, resampling, secrets, sharding, simhash, suffix_dedup, token_counts, vector_graph
from .common import table


def op1_simhash_near_dedup(spark, sf_dir):
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), width=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def op3_secret_scans(spark, sf_dir):
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = secrets.span_text(F.col("spans"))
    return found.select("doc_id", *[of(k) for k in secrets.KINDS], F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"))


def op4_best_fit_packing(spark, sf_dir):
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    return packing.best_fit_packing(counted, F.col("n_tokens"))


def op5_benchmark_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    items = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs), keep_text=False)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_lm_scoring(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"), held_out)


def op9_nearest_neighbours(spark, sf_dir):
    return vector_graph.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_feistel_shards(spark, sf_dir):
    return sharding.feistel_shards(table(spark, sf_dir, "documents"), 16).drop("row_number")


def op11_byte_bpe(spark, sf_dir):
    encoded = byte_bpe.bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, keep_text=False)
    found = byte_bpe.bpe_decode(encoded, BYTE_BPE)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(byte_bpe.ids_text(F.col("ids"))).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op12_importance_resampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resampling.resample(docs, table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_source_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


BYTE_BPE = "byte_bpe_50k.json"
QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_token_counts, op3_secret_scans, op4_best_fit_packing, op5_benchmark_decontamination, op6_language_id, op7_suffix_dedup, op8_lm_scoring, op9_nearest_neighbours, op10_feistel_shards, op11_byte_bpe, op12_importance_resampling, op13_source_divergence)}
#: Words of a text, as lists, in DuckDB.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

#: The others need a tokenizer, a given hash function, a trained model, a best fit or a graph; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    # a match begins after the pieces and matches before it
    "op3_secret_scans": f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    m AS (SELECT r, 0 AS k, 'assign' AS kind, 6 AS least, string_split_regex(t, '{ASSIGN}') AS p, regexp_extract_all(t, '{ASSIGN}') AS m, regexp_extract_all(t, '{ASSIGN}', 2) AS g FROM d
      UNION ALL SELECT r, 1, 'access', 20, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
      UNION ALL SELECT r, 2, 'hex', 24, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM d),
    l AS (SELECT r, k, kind, least, list_transform(p, lambda y: length(y)) AS p, list_transform(m, lambda y: length(y)) AS m, list_transform(g, lambda y: length(y)) AS g FROM m WHERE len(list_filter(g, lambda y: length(y) >= least)) > 0),
    s AS (SELECT r, k, kind, least, p, m, unnest(g) AS n, unnest(range(1, len(m) + 1)) AS i FROM l),
    e AS (SELECT r, k, kind, list_sum(p[1:i]) + coalesce(list_sum(m[1 : i - 1]), 0) AS a, m[i] AS size FROM s WHERE n >= least),
    j AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, k) AS spans FROM e GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (r)""",
    "op5_benchmark_decontamination": f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
    b AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
    p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)),
    x AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n),
    o AS (SELECT r, k, p.n, p.item_id FROM x JOIN p ON p.n = x.n AND array_to_string(w[k : k + x.n - 1], ' ') = p.s),
    h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS j FROM o) GROUP BY 1),
    i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM o) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)""",
    # a checksum goes on byte by byte; of a bigram's, from that of its first word
    "op12_importance_resampling": f"""
    WITH RECURSIVE z AS (SELECT 0 AS k, range(256)::BIGINT[] AS c UNION ALL SELECT k + 1, list_transform(c, lambda v: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)) FROM z WHERE k < 8),
    d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
    b AS (SELECT {WORDS} AS w FROM benchmark),
    f AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS s FROM d),
    g AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS s FROM b),
    u AS (SELECT s, hex(encode(s)) AS h, (SELECT c FROM z WHERE k = 8) AS c FROM (SELECT s FROM f UNION SELECT s FROM g)),
    k AS (SELECT s, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i : i + 1])::BIGINT)), lambda a, v: xor(a >> 8, c[(xor(a, v) & 255) + 1]))) % 10000 AS bucket FROM u),
    fs AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (s) GROUP BY 1),
    gt AS (SELECT bucket, count(*) AS t FROM g JOIN k USING (s) GROUP BY 1),
    n AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT count(*) FROM f) + 10000) / ((s + 1) * ((SELECT count(*) FROM g) + 10000))))::BIGINT AS gain FROM fs LEFT JOIN gt USING (bucket)),
    e AS (SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN k USING (s) JOIN n USING (bucket) GROUP BY r),
    o AS (SELECT r, doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
      coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN e USING (r)),
    p AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (WHERE words >= 20) OVER () AS fit FROM o)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * fit // 100 THEN place END AS rank FROM p""",
    "op13_source_divergence": """
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    g AS (SELECT DISTINCT lang, source FROM d),
    f AS (SELECT r, lang, source, unnest(w) AS term FROM d),
    k AS (SELECT lang, term FROM f GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
    v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY 1),
    c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM f SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
    n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY 1, 2),
    l AS (SELECT lang, sum(n)::HUGEINT AS n FROM n GROUP BY 1),
    q AS (SELECT lang, term, 1 + 1000000000 * (sum(c)::HUGEINT + 5) // (any_value(l.n) + 5 * any_value(v)) AS q FROM c JOIN l USING (lang) JOIN v USING (lang) GROUP BY 1, 2),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000 * (coalesce(c, 0) + 5) // (coalesce(n, 0) + 5 * v) AS p FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    m AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN m ON m.lang = x.lang AND m.source = x.source AND m.item = y.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM a) WHERE part = 'pair' OR rank <= 50""",
    # windows by their digest; the bytes between removed runs are put together in hexadecimal
    "op7_suffix_dedup": """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    w AS (SELECT r, s, md5(array_slice(b, s + 1, s + 400)) AS h FROM (SELECT r, b, unnest(range(0, n - 399)) AS s FROM d WHERE n >= 400)),
    t AS (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
    i AS (SELECT r, s, sum(CASE WHEN s - p <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY s) AS run FROM t),
    g AS (SELECT r, run, min(s) AS a, max(s) + 400 AS e FROM i GROUP BY r, run),
    k AS (SELECT r, list(a ORDER BY a) AS a, list(e ORDER BY a) AS e, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM g GROUP BY r),
    x AS (SELECT d.r, b, unnest(list_append(a, n)) AS z, unnest(list_prepend(0, e)) AS y FROM d JOIN k ON d.r = k.r),
    q AS (SELECT r, sha256(unhex(string_agg(CASE WHEN z > y THEN hex(array_slice(b, y + 1, z)) ELSE '' END, '' ORDER BY y))) AS kept FROM x GROUP BY r)
    SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept, sha256(b)) AS kept_sha256 FROM d LEFT JOIN k USING (r) LEFT JOIN q USING (r)""",
}
