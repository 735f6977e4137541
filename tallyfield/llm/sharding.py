"""Operator 10, native: shards by a keyed Feistel permutation of global row numbers.

Every row gets a gapless row number (its bucket's offset plus its place in the bucket; equal rows are counted and dealt in chunks), the permutation of [0, n) sends it
to another one, and the result modulo the number of shards is the shard, divided by it the slot. Only column expressions
are used. The permutation is balanced over the least power of two that holds n, and cycle walking (apply it again while
the image is not below n) restricts it to [0, n). Text isn't shuffled: only the id, size and checksum are.

Null texts have size 1 and the checksum of the empty string. Rows repeated in every column are interchangeable and each
gets a slot of its own. A null id is an ordinary value. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
#: Each step of a cycle walk leaves [0, n) with a chance below 1/2; a row that has not come back after so many raises an error.
WALKS = 96
#: Rows in a numbering bucket, on average.
BUCKET_ROWS = 20_000
#: Equal rows that are numbered together.
CHUNK_ROWS = 4096


def feistel(x: Column, n: int, seed: int) -> Column:
    """The image of x, in [0, n), under the keyed permutation; usable for any row number without the table."""
    bits = max(2, (n - 1).bit_length())
    right = bits // 2
    widths = [(bits - right, right) if r % 2 == 0 else (right, bits - right) for r in range(ROUNDS)]
    rounds = F.array(*[F.struct(F.lit(r).cast("long").alias("key"), F.lit(w[0]).alias("l"), F.lit(w[1]).alias("r")) for r, w in enumerate(widths)])

    def one(acc: Column, key: Column) -> Column:
        low = acc.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), key["r"]) - 1)
        high = F.call_function("shiftright", acc, key["r"])
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), key["l"]) - 1
        mixed = high.bitwiseXOR(F.xxhash64(low, key["key"], F.lit(seed)).bitwiseAND(mask))
        return F.call_function("shiftleft", low, key["l"]).bitwiseOR(mixed)

    walk = lambda start: F.aggregate(rounds, start, one)
    image = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), walk(x.cast("long")), lambda acc, _: F.when(acc >= n, walk(acc)).otherwise(acc))
    return F.when(image < n, image).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def numbered(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The columns keys of each of rows with row_number, gapless from 0, fixed by their values.

    Equal rows are counted before the shuffle and then stand in chunks of up to CHUNK_ROWS; chunks are bucketed by hash, so neither the
    whole table nor any number of equal rows is ordered or numbered in one task.
    """
    equal = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    chunks = equal.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK_ROWS}"))))
    chunks = chunks.withColumn("own", F.least(F.lit(CHUNK_ROWS).cast("long"), F.col("n") - F.col("chunk") * CHUNK_ROWS)).drop("n")
    chunks = chunks.withColumn("bucket", F.pmod(F.xxhash64(*keys, "chunk"), F.lit(buckets)))
    sizes = chunks.groupBy("bucket").agg(F.sum("own").alias("in_bucket"))
    ends = sizes.withColumn("offset", F.sum("in_bucket").over(Window.orderBy("bucket")) - F.col("in_bucket")).select("bucket", "offset")
    before = F.sum("own").over(Window.partitionBy("bucket").orderBy(*keys, "chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")
    placed = chunks.withColumn("before", before).join(ends, "bucket")
    return placed.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1)).alias("place"), "before", "offset").select(*keys, (F.col("offset") + F.col("before") + F.col("place")).alias("row_number"))


def feistel_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of df; law is `rows`: counts differ by one at most."""
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).alias("id"), (F.length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"))
    n = df.count()
    image = feistel(F.col("row_number"), max(n, 1), seed)
    out = numbered(rows, ["id", "text_crc32", "size"], max(1, n // BUCKET_ROWS)).withColumn("image", image)
    return out.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("image", F.lit(shards)).cast("int").alias("shard"), F.expr(f"image div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
