"""Tables with nulls, empty and long texts, repeats and clashing column names."""

from __future__ import annotations

import random

LONG = " ".join(random.Random(5).choices(["alpha", "beta", "gamma", "delta", "the", "of", "é"], k=60_000))
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "Hello there"), (None, "Hello there"), (None, None), (5, "Hello there"), (5, "Hello there"), (6, LONG), (7, "!!! 123"), (8, "a"), (9, "token=abcdef1234 x")]
#: Names that the operators use inside.
CLASHING = ["id", "data", "row", "spans", "score", "fp", "node", "rid", "size", "blob", "hash", "keys", "items", "bucket"]


def odd(spark, rows=TEXTS):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    lang = F.when(F.col("doc_id") % 2 == 0, "en")
    return df.select("doc_id", "text", lang.alias("lang"), *[F.lit(f"extra {c}").alias(c) for c in CLASHING])


def empty(spark):
    return odd(spark).filter("false")


def word_text(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
