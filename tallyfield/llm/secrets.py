"""Operator 3: secret scans with an incremental blob ledger.

Every version of every path is addressed by its content: the SHA-256 of its bytes is the blob. The ledger is a table of
(blob, rule_version, spans). A run anti-joins the blobs at hand with the ledger, reads the text of one path for each unseen
blob only, scans it, appends to the ledger, and joins the spans back to all paths. Only ids and digests are grouped; a
blob with any number of paths or repeated rows is one row of that grouping, is scanned once and has one row in the ledger. The anti-join takes part from a ledger's second run
on: runs share one that is given, or named by the setting SETTING; else each has its own and every blob is unseen.

Null texts are the empty blob. Null ids and repeated rows each give a row. Texts are scanned whole. Extra columns stay out.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, temporary, text_bytes

KINDS = ("assign", "access", "hex")
#: (kind, pattern, group whose length counts, least length)
RULES = (
    ("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Other rules, another version: what older ones found never stands in for it.
RULE_VERSION = "rules-" + hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
COMPILED = [(kind, re.compile(pattern), group, least) for kind, pattern, group, least in RULES]
SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob binary, rule_version string, spans {SPANS}"
#: Setting of the session that names a lasting ledger; without it a run has one of its own.
SETTING = "spark.tallyfield.secrets.ledger"


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points by start, then kind as in KINDS. A greedy run of hex digits is one match, so its least length can stand in the pattern."""
    found = []
    for k, (_, pattern, group, least) in enumerate(COMPILED):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


#: Blobs that a task remembers as seen.
SEEN = 100_000


def first_rows(batches):
    """Arrow batches less rows whose first two values the task has just had: repeated rows end here, before anything is shuffled or scanned."""
    seen: set[tuple] = set()
    for b in batches:
        keep = []
        for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            keep.append(key not in seen)
            seen.add(key)
        if len(seen) > SEEN:
            seen.clear()
        yield b.filter(pa.array(keep, pa.bool_()))


def scan_blobs(batches):
    """Arrow batches of (path, blob, text) to batches of (blob, spans), one for each blob."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in first_rows(batches):
        b = b.select(["blob", "text"])
        spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_secrets(t or "")] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["blob", "spans"])


def update_ledger(versions: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan the blobs of versions that the ledger, a Parquet folder in shared storage, lacks for RULE_VERSION; return its rows for that version."""
    spark = versions.sparkSession
    small_batches(spark)
    addressed = versions.select(F.col(id_col).alias("path"), F.unhex(F.sha2(text_bytes(text_col), 256)).alias("blob"), F.col(text_col).alias("text"))
    unseen = addressed.groupBy("blob").agg(F.min("path").alias("first"))
    if seen := _ledger(spark, ledger):
        unseen = unseen.join(seen.select("blob"), "blob", "left_anti")
    # one path for each blob; only a blob without any path is fetched by all its rows
    first = unseen.select(F.col("first").alias("path"), "blob")
    rows = addressed.select("path", "blob", "text").mapInArrow(first_rows, addressed.select("path", "blob", "text").schema)
    fetched = rows.join(first.select(F.col("path").alias("first"), F.col("blob").alias("unseen")).hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("first")) & (F.col("blob") == F.col("unseen")))
    # equal rows are dealt alike and meet in the task that scans them; where skew or a small table kept them apart, one of their findings is taken
    scanned = fetched.select("path", "blob", "text").mapInArrow(scan_blobs, f"blob binary, spans {SPANS}").dropDuplicates(["blob"]).withColumn("rule_version", F.lit(RULE_VERSION))
    scanned.write.mode("append").partitionBy("rule_version").parquet(ledger)
    return _ledger(spark, ledger)


def _ledger(spark, path: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    # two runs at once may both have scanned a blob; one entry counts
    rows = spark.read.schema(LEDGER).parquet(path).filter(F.col("rule_version") == RULE_VERSION)
    return rows.groupBy("blob").agg(F.first("spans").alias("spans"))


def ledger_of(spark, ledger: str | None) -> str:
    """The ledger given, else that of the session's setting, else a new one in the shared folder."""
    return ledger or spark.conf.get(SETTING, None) or temporary(spark, "blob-ledger")


def secret_spans(df: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blob, spans) for every row of df; spans is empty where nothing was found."""
    # stored, so that both sides of the join are dealt for it and a blob with many paths can be split
    found = stored(update_ledger(df, ledger_of(df.sparkSession, ledger), id_col, text_col).filter(F.size("spans") > 0), "findings")
    paths = df.select(F.col(id_col), F.unhex(F.sha2(text_bytes(text_col), 256)).alias("blob"))
    none = F.array().cast(SPANS)
    return paths.join(found, "blob", "left").select(id_col, "blob", F.coalesce("spans", none).alias("spans"))


def span_text(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def cut_out(text, spans):
    """text with [kind] in the place of each span, overlapping ones as one; spans are in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("end"))
    between = lambda end, a: F.substring(text, end + 1, a - end)

    def step(acc, s):
        added = F.concat(acc["out"], between(acc["end"], s["start"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(s["start"] >= acc["end"], added).otherwise(acc["out"]).alias("out"), F.greatest(acc["end"], s["end"]).alias("end"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], between(acc["end"], F.length(text))))


def redact(df: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with every found span replaced by `[kind]`, overlapping spans as one; other rows and columns stay as they are."""
    found = update_ledger(df, ledger_of(df.sparkSession, ledger), id_col, text_col).filter(F.size("spans") > 0)
    found = stored(found.select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans")), "findings")
    rows = df.withColumn("__blob", F.unhex(F.sha2(text_bytes(text_col), 256))).join(found, "__blob", "left")
    text = F.col(f"`{text_col}`")
    return rows.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(cut_out(text, F.col("__spans")))).select(*[f"`{c}`" for c in df.columns])
