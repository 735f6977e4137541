"""The corpus pipeline: language ID, near-dedup, decontamination, secret redaction and packing, each by an operator of tallyfield.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again for the next one. All
stages but the last return the columns of documents.

Null and empty texts go in the first stage. Repeated rows are copies, of which the second one keeps one. Rows without an id stay only where no
copy has one. Texts of any length are read whole. Extra columns stay as they are, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import decontaminate, language_id, packing, secrets, simhash, token_counts
from tallyfield.llm.common import drop_stored, scratch, table

#: The tokenizer whose tokens are packed.
TOKENIZER = "piece_bpe_32k.model"


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that language ID rejects: null, without letters, or of some length and unlike the language predicted for them.

    Without any labelled row only texts without letters go.
    """
    found = language_id.identify(docs.select(F.struct(*docs.columns).alias("doc"), "text"), language_id.train(docs), keep_text=False)
    return found.filter(~F.col("rejected")).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the least id, of each group whose 5-word shingles are similar to 0.8 or more."""
    return simhash.first_of_each(docs, width=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item, or all of a shorter one."""
    found = decontaminate.benchmark_hits(docs.select(F.struct(*docs.columns).alias("doc"), "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.filter(F.size("spans") == 0).select("doc.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind of a secret in its place; all documents stay."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of permitted sequence lengths for all documents."""
    return packing.best_fit_packing(token_counts.token_counts(docs, TOKENIZER), F.col("n_tokens"))


STAGES = [
    ("language_id", keep_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: SQL has no language model, tokenizer or best fit; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows. What a stage stores on its way is deleted when its rows are written, and these when the next ones are."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as kept:
            now = kept(stage(spark, docs, sf_dir), name)
        if k:
            drop_stored(docs)
        docs = now
    return STAGES[-1][1](spark, docs, sf_dir)
