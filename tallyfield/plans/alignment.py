"""Speaker and face alignment of one source: the analytic read made of range joins, votes and rollups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.operators import joins as J

from .joins import LONGEST, OTHERS, TEN, TURNS, other_spans, turns
from .registry import query

PAIRS = f"SELECT q.turn_id, q.label, q.t0, q.t1, o.event_id, o.word FROM ({TURNS}) q JOIN ({OTHERS}) o ON q.user_id % 10 = o.user_id % 10 AND o.s BETWEEN q.t0 AND q.t1"
DOMINANT = f"""SELECT turn_id, label, t0, t1, arg_max(word, n * 1000 - ascii(word)) AS face, max(n) AS votes, sum(n) AS seen FROM (SELECT turn_id, label, t0, t1, word, count(*) AS n FROM ({PAIRS}) GROUP BY ALL) GROUP BY ALL"""


def dominant_faces(t):
    """Each turn with the most frequent face of the detections inside it."""
    at = other_spans(t).select(F.expr(TEN).alias("g"), "word", F.col("s").alias("at"))
    held = turns(t).select(F.expr(TEN).alias("g"), "turn_id", "label", "t0", "t1")
    counted = J.range_join(at, held, ["g"], "at", "t0", "t1", 1800, longest=LONGEST).groupBy("turn_id", "label", "t0", "t1", "word").agg(F.count("*").alias("n"))
    return counted.groupBy("turn_id", "label", "t0", "t1").agg(F.max_by("word", F.col("n") * 1000 - F.ascii("word")).alias("face"), F.max("n").alias("votes"), F.sum("n").alias("seen"))


@query(f"SELECT turn_id, label, face, round(t1 - t0, 6) AS duration FROM ({DOMINANT}) WHERE face <> label ORDER BY round(t1 - t0, 6) DESC, turn_id LIMIT 50")
def cmp_disagree(t, spark):
    rows = dominant_faces(t).filter("face <> label").select("turn_id", "label", "face", F.round(F.col("t1") - F.col("t0"), 6).alias("duration"))
    return rows.orderBy(F.desc("duration"), "turn_id").limit(50)


@query(f"""SELECT q.turn_id, q.label AS speaker, d.face, d.votes / d.seen AS share, CASE WHEN d.face IS NULL THEN 'partial' WHEN d.face = q.label THEN 'agree' ELSE 'disagree' END AS agreement FROM ({TURNS}) q LEFT JOIN ({DOMINANT}) d ON q.turn_id = d.turn_id""")
def cmp_timeline(t, spark):
    faces = dominant_faces(t).select("turn_id", "face", (F.col("votes") / F.col("seen")).alias("share"))
    rows = turns(t).select("turn_id", F.col("label").alias("speaker")).join(faces, "turn_id", "left")
    return rows.withColumn("agreement", F.when(F.col("face").isNull(), "partial").when(F.col("face") == F.col("speaker"), "agree").otherwise("disagree"))


@query(f"""WITH p AS ({PAIRS}), c AS (SELECT label, word, count(*) AS n FROM p GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY label) AS share, row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS rn FROM c)
    SELECT label, word AS face, n, share FROM s WHERE rn = 1""")
def identity_alignment(t, spark):
    at = other_spans(t).select(F.expr(TEN).alias("g"), "word", F.col("s").alias("at"))
    held = turns(t).select(F.expr(TEN).alias("g"), "turn_id", "label", "t0", "t1")
    counted = J.range_join(at, held, ["g"], "at", "t0", "t1", 1800, longest=LONGEST).groupBy("label", F.col("word").alias("face")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("label")
    ranked = counted.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "face")))
    return ranked.filter("rn = 1").drop("rn")
