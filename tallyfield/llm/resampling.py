"""Operator 12: target-distribution importance resampling with word-id suffix arrays.

Texts are lower-cased (A-Z only) and cut into words; the features of a text are its runs of 1 to `longest` words, repeats included, and each
has a bucket: the CRC-32 of its bytes modulo `buckets`. A task lays the words of some texts out as one array of ids, a separator after each text, orders its
suffixes by their first `longest` ids, and takes the common prefixes of neighbours: a run of neighbours that share k words is one feature of k words, hashed once. Its
bucket is then scattered back to all its places. The same pass counts the buckets of a corpus and, given the buckets' gains, weights its texts.

A bucket's gain is floor(1000 * ln of how much more often the target has it than the corpus), both smoothed by one; a text's weight is the
floored mean of its gains. Gumbel noise from the id's digest makes the highest scores a draw without replacement in proportion to exp(weight / 1000). Scores are
ranked by range partitions: each is sorted, and its rows' places follow from the sizes of those before it.

A null or empty text, or one without words, has no features, weight 0, and is never drawn where texts need a word. A null id has the digest of an empty one and comes last among ties.
Repeated rows are drawn one by one. Texts are counted whole; one of more bytes than CHUNK is laid out alone. An empty corpus gives no rows; an empty
target leaves t and T at 0. Other columns pass through, but for those named like the results, which these replace.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Bytes of text that a task lays out in one suffix array.
CHUNK = 8 << 20
#: ASCII letters in lower case, digits and all bytes above ASCII belong to words; others part them.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
RESULTS = ("n_features", "weight", "score", "rank")


#: Bytes by which checksums are moved on by tables; for longer words zlib does it.
LONGEST_STEP = 128


def steps() -> np.ndarray:
    """(length, place, byte): what a byte at a place of a CRC-32 becomes when so many zero bytes follow. A checksum is the sum of its four bytes' values, modulo 2."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1)
    table = np.empty((LONGEST_STEP + 1, 4, 256), np.uint32)
    table[0] = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for k in range(LONGEST_STEP):
        table[k + 1] = table[k] >> 8 ^ one[table[k] & 255]
    return table


STEPS = steps()


class Ids(dict):
    """A number for each word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def laid_out(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word ids of texts in a row with -1 after each text, words of each text, and the words by id."""
    ids, parts, sizes = Ids(), [], []
    end = np.array([-1])
    for t in texts:
        words = t.translate(WORDS).split() if t else []
        sizes.append(len(words))
        parts += [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), end]
    return np.concatenate(parts) if parts else end[:0], np.array(sizes, np.int64), list(ids)


def shared_prefixes(word: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The places of words, ordered by the `longest` ids from there on; those ids, in that order; and for each k the places in that order where the first k ids differ from the place before.

    Past a text's end every id is the separator, so no prefix that a run shares crosses it.
    """
    padded = np.concatenate([word, np.full(longest, -1)])
    at = np.flatnonzero(word >= 0)
    columns = [padded[at + k] for k in range(longest)]
    for k in range(1, longest):  # beyond a separator nothing counts
        columns[k] = np.where(columns[k - 1] < 0, -1, columns[k])
    if longest <= 2 and len(word) < 1 << 31:  # one key a place sorts faster than two
        order = np.argsort(sum(((c + 1) << 32 * (longest - 1 - k) for k, c in enumerate(columns)), np.int64(0)), kind="stable")
    else:
        order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    starts, new = [], np.arange(len(at)) == 0
    for c in columns:
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
        starts.append(new)
    return at[order], columns, starts


def feature_buckets(texts: list[bytes | None], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(k, place) of each word's place: the bucket of the feature of k words that begins there, -1 if the text ends before; and words of each text."""
    word, sizes, words = laid_out(texts)
    suffixes, columns, starts = shared_prefixes(word, longest)
    found = np.full((longest, len(word)), -1, np.int32)
    if not len(words):
        return found, sizes
    crc, last = np.zeros(0, np.uint32), None
    own = np.fromiter(map(crc32, words), np.uint32, len(words))
    parted = np.fromiter((crc32(b" " + w) for w in words), np.uint32, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    for k, (ends, new) in enumerate(zip(columns, starts, strict=True)):
        tail, run = ends[new], np.cumsum(new) - 1  # the last word of each run's feature; -1: the text ended before
        whole = tail >= 0
        if k == 0:
            now = own[tail]
        else:  # a run's checksum goes on from that of the run of k words around it
            now, around, size = np.zeros(len(tail), np.uint32), crc[last[new]], length[tail]
            short = whole & (size <= LONGEST_STEP)
            c, n = around[short], size[short]
            now[short] = parted[tail[short]] ^ STEPS[n, 0, c & 255] ^ STEPS[n, 1, c >> 8 & 255] ^ STEPS[n, 2, c >> 16 & 255] ^ STEPS[n, 3, c >> 24]
            for j in np.flatnonzero(whole & ~short).tolist():
                now[j] = crc32(b" " + words[tail[j]], int(around[j]))
        found[k, suffixes] = np.where(whole, (now % np.uint32(buckets)).astype(np.int32), -1)[run]
        crc, last = now, run
    return found, sizes


def chunks(batches, column: int):
    """Arrow batches in groups of about CHUNK bytes of text, so that one array covers many batches of a partition."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column(column).nbytes
        if size >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def texts_of(t: pa.Table, name: str) -> list[bytes | None]:
    return t.column(name).to_pylist()


def bucket_counts(df: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. Tasks send one count a bucket; the driver gets `buckets` numbers."""
    small_batches(df.sparkSession)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for t in chunks(batches, 0):
            found, _ = feature_buckets(texts_of(t, "text"), longest, buckets)
            total += np.bincount(found[found >= 0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    counted = df.select(F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t, k = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + k) / ((int(a) + 1) * (t + k)))) for a, b in zip(corpus, target, strict=True)], np.int64)


def importance_weights(df: DataFrame, target: DataFrame, text_col: str = "text", longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """df with n_words, n_features and weight of each row's text; texts themselves stay out."""
    gain = gains(bucket_counts(df, text_col, longest, buckets), bucket_counts(target, text_col, longest, buckets))

    def weigh(batches):
        for t in chunks(batches, 1):
            found, sizes = feature_buckets(texts_of(t, "text"), longest, buckets)
            owner = np.repeat(np.arange(len(sizes)), sizes + 1)  # a text's places, its separator too
            total, n = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for row in found:
                real = row >= 0
                total += np.bincount(owner[real], gain[row[real]], len(sizes)).astype(np.int64)  # whole numbers below 2^53, so exact
                n += np.bincount(owner[real], minlength=len(sizes))
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield from pa.table([t.column("row"), pa.array(sizes), pa.array(n), pa.array(weight)], names=["row", "n_words", "n_features", "weight"]).to_batches()

    kept = [c for c in df.columns if c != text_col and c.lower() not in ("n_words", *RESULTS)]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")]).alias("row"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    zero = F.lit(0).cast("long")
    schema = rows.select("row").withColumns({"n_words": zero, "n_features": zero, "weight": zero}).schema
    return rows.mapInArrow(weigh, schema).select(*[F.col(f"row.`{c}`") for c in kept], "n_words", "n_features", "weight")


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(1000 * g), g from the Gumbel distribution by the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(df: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """df with `rank` from 1 in the given order, which must not leave ties.

    Rows are dealt to `parts` ranges and sorted there; a row's rank is its place in its range after the rows of the ranges before, whose sizes go
    through the driver, one number a range. df must give the same rows each time, so it is a stored table.
    """
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    placed = stored(placed, "ranges")
    part = F.expr("shiftright(__place, 33)")
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(k, 0)
    before = F.element_at(F.array(*[F.lit(v).cast("long") for v in offsets or [0]]), part.cast("int") + 1)
    return placed.withColumn("rank", before + F.expr(f"__place & {(1 << 33) - 1}") + 1).drop("__place")


def resample(df: DataFrame, target: DataFrame, percent: int, least_words: int, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """df without its texts, with n_features, weight, score and rank: floor(percent * N / 100) of the N texts of least_words words or more are drawn and ranked, the others' rank is null."""
    weighed = importance_weights(df, target, text_col, longest, buckets)
    weighed = weighed.withColumn("score", F.col("weight") + gumbel(F.col(f"`{id_col}`"), seed))
    weighed = stored(weighed, "weights").withColumn("__turn", F.monotonically_increasing_id())
    fit = F.col("n_words") >= least_words
    n = weighed.filter(fit).count()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last(f"`{id_col}`"), F.asc("__turn")]
    drawn = percent * n // 100
    found = ranked(weighed.filter(fit), order, parts).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = weighed.filter(~fit).withColumn("rank", F.lit(None).cast("long"))
    return found.unionByName(others).drop("__turn", "n_words")
