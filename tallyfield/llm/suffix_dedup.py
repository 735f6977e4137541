"""Operator 7: removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first `length` bytes, by most-significant-digit passes; equal groups are the repeated
windows. Each pass names a digit and goes on with groups of two or more:

1. The digit is a gram of GRAM bytes: of all grams in a window, the one with the least hash. Equal windows have it at the same offset, so
   about 2 of length - GRAM + 2 positions are dealt instead of all; those whose gram is nowhere else drop out.
2. The windows around a gram fall into blocks of BLOCK neighbouring starts. The digit is the core that all windows of a
   block share, by a 128-bit hash.
3. In a group of equal cores the rest of a window, fewer than BLOCK bytes at both ends, is ordered by digits of 8 bytes, one pass after another.

A core of over 350 bytes is a digit by its hash, as the bytes of all blocks would be many times the input; only what stands beside it is moved.

Equal texts are one suffix set: a text with copies is removed whole if it holds a window at all, and takes part once. Groups of the third
pass are streamed in order. A gram that stands more than GROUP times may lead to a group of more rows: what comes from it is dealt by single
windows instead, whose counts are aggregated before the shuffle.

Null and empty texts have no bytes. Matches never cross documents. Repeated rows are copies of each other. Null ids are
ordinary values. Texts of any length are read whole, in pieces that overlap. Extra columns stay out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, tasks, text_bytes

GRAM, BLOCK, GROUP = 100, 32, 50_000
BITS = 20
PIECE = 1 << BITS
MULTIPLIER = 0x9E3779B97F4A7C15


class Grams:
    """The chosen gram of every window, for texts put side by side in pieces."""

    def __init__(self, length: int):
        if length < GRAM + BLOCK:
            raise ValueError(f"length must be {GRAM + BLOCK} or more")
        self.length, self.window = length, length - GRAM + 1
        m, back = np.uint64(MULTIPLIER), np.uint64(pow(MULTIPLIER, -1, 2**64))
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE - 1, m)]), dtype=np.uint64)
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE - 1, back)]), dtype=np.uint64)

    def runs(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of one piece of texts that end at ends: (gram hash, position, first start, last start) for each run of starts with the same chosen gram."""
        n = len(data)
        if n < self.length:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], dtype=np.uint64)])
        h = (total[GRAM:] - total[:-GRAM]) * self.inverse[: n - GRAM + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        count = n - self.length + 1
        key = (h >> np.uint64(BITS) << np.uint64(BITS)) | np.arange(len(h), dtype=np.uint64)
        w = self.window
        padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(key)] = key
        rows = padded.reshape(-1, w)
        prefix = np.minimum.accumulate(rows, axis=1).ravel()
        suffix = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(suffix[:count], prefix[w - 1 : w - 1 + count]) & np.uint64(PIECE - 1)).astype(np.int64)
        start = np.arange(count)
        text = np.searchsorted(ends, start, side="right")
        valid = start + self.length <= ends[np.minimum(text, len(ends) - 1)]
        start, at = start[valid], at[valid]
        if not len(start):
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        cut = np.concatenate([[True], (np.diff(at) != 0) | (np.diff(start) != 1)])
        first = np.flatnonzero(cut)
        last = np.concatenate([first[1:] - 1, [len(start) - 1]])
        return h[at[first]].view(np.int64), at[first], start[first], start[last]

    def of(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each text the runs (gram hash, gram position, first start, last start)."""
        out: list[list] = [[] for _ in texts]
        group: list[tuple[int, int, bytes]] = []
        size = 0

        def flush():
            nonlocal group, size
            if group:
                ends = np.cumsum([len(p) for _, _, p in group])
                begins = ends - [len(p) for _, _, p in group]
                found = self.runs(np.frombuffer(b"".join(p for _, _, p in group), np.uint8), ends)
                which = np.searchsorted(ends, found[2], side="right")
                for k, h, at, a, b in zip(which.tolist(), *(x.tolist() for x in found), strict=True):
                    doc, base, _ = group[k]
                    base -= int(begins[k])
                    out[doc].append((h, at + base, a + base, b + base))
            group, size = [], 0

        for doc, text in enumerate(texts):
            for a in range(0, max(1, len(text) - self.length + 1), PIECE - self.length + 1):
                part = text[a : a + PIECE]
                if len(part) < self.length:
                    continue
                if size + len(part) > PIECE:
                    flush()
                group.append((doc, a, part))
                size += len(part)
        flush()
        return out


RUNS = "array<struct<h:long,at:int,a:int,b:int>>"
#: Parts of a window: its core's key, then its bytes beside the core.
WINDOW = ["k1", "k2", "j", "edge"]
RUN_TYPE = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("a", pa.int32()), ("b", pa.int32())]))


def chosen_grams(length: int):
    def over(batches):
        grams = Grams(length)
        for b in batches:
            runs = [[dict(zip("h at a b".split(), r, strict=True)) for r in own] for own in grams.of(b.column("data").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "n_bytes", "digest", "sha")), pa.array(runs, RUN_TYPE)], names=["id", "n_bytes", "digest", "sha", "runs"])

    return over


BLOCKS = "k1 long, k2 long, rid long, at int, low int, high int, left binary, right binary"
DEALT = f"{BLOCKS}, often boolean"


def blocks(length: int):
    """Arrow batches of (rid, data, runs) to the blocks of their runs: starts at - high to at - low, a core from at on; often is the run's."""
    core, names = length - BLOCK + 1, [c.split()[0] for c in DEALT.split(", ")]
    types = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.bool_()]

    def over(batches):
        for b in batches:
            out: list[tuple] = []
            for rid, data, runs in zip(*(b.column(c).to_pylist() for c in ("rid", "data", "runs")), strict=True):
                for r in runs:
                    low, high = r["at"] - r["b"], r["at"] - r["a"]  # offsets of the gram in its windows
                    for x in range(low // BLOCK, high // BLOCK + 1):
                        at = r["at"] - x * BLOCK
                        lo, hi = max(low - x * BLOCK, 0), min(high - x * BLOCK, BLOCK - 1)
                        d = xxhash.xxh3_128_digest(data[at : at + core], seed=x)
                        out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), rid, at, lo, hi, data[at - hi : at], data[at + core : at + core + BLOCK - 1 - lo], r["often"]))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return over


STARTS = f"{BLOCKS}, first int, last int"
EDGE = BLOCK - 1


def padded(column: pa.Array, right: bool) -> np.ndarray:
    """Binary values of up to EDGE bytes as rows of a matrix, zeros before or after them."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"\0", np.uint8)
    place = (at[1:, None] - EDGE if right else at[:-1, None]) + np.arange(EDGE)
    inside = (place >= at[:-1, None]) & (place < at[1:, None])
    return np.where(inside, data[np.where(inside, place, 0)], 0).astype(np.uint8)


def repeated(group: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each row and offset whether the window is elsewhere too in its group: digit passes of 8 bytes over what stands beside the core, groups of one leave after each."""
    again = np.zeros((len(group), BLOCK), bool)
    for j in range(BLOCK):
        at = np.flatnonzero((low <= j) & (j <= high))
        if len(at) < 2:
            continue
        edge = np.zeros((len(at), BLOCK), np.uint8)
        edge[:, :j] = left[at, EDGE - j :]
        edge[:, j:EDGE] = right[at, : EDGE - j]
        digits, of = edge.view(np.uint64), group[at]
        for d in range(digits.shape[1]):
            order = np.lexsort((digits[:, d], of))
            at, of, digits = at[order], of[order], digits[order]
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (digits[1:, d] != digits[:-1, d]), [True]])
            more = ~(new[:-1] & new[1:])
            at, of, digits = at[more], np.cumsum(new[:-1])[more], digits[more]
            if not len(at):
                break
        again[at, j] = True
    return again


def repeated_starts(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of whole groups of equal cores, in order: (rid, first, last) for runs of starts whose windows are elsewhere too."""
    k1, k2, rid, at, low, high = (rows.column(c).to_numpy() for c in range(6))
    new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]), [True]])
    more = np.flatnonzero(~(new[:-1] & new[1:]))
    rows, group = rows.take(pa.array(more)), np.cumsum(new[:-1])[more]
    rid, at, low, high = rid[more], at[more], low[more], high[more]
    again = repeated(group, low, high, padded(rows.column(6), True), padded(rows.column(7), False))
    # a greater offset is an earlier start
    edge = np.diff(np.pad(again[:, ::-1].astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, begin), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return rid[row], at[row] - (EDGE - begin), at[row] - (BLOCK - end)


def equal_groups(batches):
    """Arrow batches of DEALT, ordered by k1 and k2, to repeated starts; frequent rows and those of a group of over GROUP rows come back as they are."""
    names = [c.split()[0] for c in STARTS.split(", ")]
    types = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.int32()] * 2
    held, given_up = None, None

    def as_they_are(b):
        return pa.RecordBatch.from_arrays([*b.columns[:8], pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.int32())], names=names)

    def found(b):
        rid, first, last = repeated_starts(b)
        none = [pa.nulls(len(rid), t) for t in types]
        return pa.RecordBatch.from_arrays([*none[:2], pa.array(rid, pa.int64()), *none[3:8], pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=names)

    for b in batches:
        if (frequent := b.filter(b.column("often"))).num_rows:
            yield as_they_are(frequent)
            b = b.filter(pc.invert(b.column("often")))
        rows = pa.concat_batches([held, b]) if held is not None else b
        if not rows.num_rows:
            continue
        k1, k2 = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        if given_up is not None:  # more of a group that was given up
            n = int(np.argmin(np.append((k1 == given_up[0]) & (k2 == given_up[1]), False)))
            if n:
                yield as_they_are(rows.slice(0, n))
            rows, k1, k2 = rows.slice(n), k1[n:], k2[n:]
            if not rows.num_rows:
                held = None
                continue
            given_up = None
        cut = int(np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))[-1])
        if cut:
            yield found(rows.slice(0, cut))
        held = rows.slice(cut)
        if held.num_rows > GROUP:
            yield as_they_are(held)
            given_up, held = (k1[cut], k2[cut]), None
    if held is not None and held.num_rows:
        yield found(held)


def single_windows(rows: DataFrame) -> DataFrame:
    """(rid, first, last) for the rows of large groups: a grouping by each window's bytes beside the core."""
    w = rows.select("k1", "k2", "rid", "at", F.explode(F.sequence("low", "high")).alias("j"), "left", "right")
    bytes_of = F.expr(f"concat(substring(left, length(left) - j + 1, j), substring(right, 1, {BLOCK - 1} - j))")
    w = w.select("k1", "k2", "rid", (F.col("at") - F.col("j")).alias("start"), "j", bytes_of.alias("edge"))
    # stored, so that a window with many rows can be split in the join
    often = stored(w.groupBy(*WINDOW).agg(F.count("*").alias("n")).filter("n > 1").select(*WINDOW), "windows")
    return w.join(often, WINDOW, "left_semi").select("rid", F.col("start").alias("first"), F.col("start").alias("last"))


def spans_of(starts, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs of windows that begin at runs of starts."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + length))
        else:
            out.append((a, b + length))
    return out


def cut_batches(length: int):
    """Arrow batches of (id, n_bytes, data, starts) to what is removed and kept."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def over(batches):
        for b in batches:
            spans, kept = [], []
            for data, starts in zip(b.column("data").to_pylist(), b.column("starts").to_pylist(), strict=True):
                own = spans_of([(s["first"], s["last"]) for s in starts], length)
                edge = [0, *(x for s in own for x in s), len(data)]
                spans.append([{"start": s, "end": e} for s, e in own])
                kept.append(hashlib.sha256(b"".join(data[edge[k] : edge[k + 1]] for k in range(0, len(edge), 2))).digest())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    return over


def repeated_spans(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept_sha256): the byte runs covered by strings of `length` bytes that start anywhere else too, and the SHA-256 of the other bytes."""
    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    data = text_bytes(text_col)
    texts = df.select(F.col(id_col).alias("id"), F.unhex(F.md5(data)).alias("digest"), data.alias("data"))
    scanned = texts.select("id", F.length("data").cast("long").alias("n_bytes"), "digest", F.unhex(F.sha2("data", 256)).alias("sha"), "data")
    scanned = scanned.mapInArrow(chosen_grams(length), f"id {id_type}, n_bytes long, digest binary, sha binary, runs {RUNS}")
    scanned = stored(scanned.withColumn("rid", F.monotonically_increasing_id()), "grams")
    distinct = stored(scanned.groupBy("digest").agg(F.min(F.struct("id", "rid")).alias("one"), F.count("*").alias("copies")), "distinct")
    ones = distinct.select(F.col("one.rid").alias("rid"), F.col("one.id").alias("one_id"), F.col("digest").alias("one_digest"), "copies")
    # first pass: grams that stand twice among distinct texts
    runs = scanned.join(ones.select("rid"), "rid", "left_semi").select("rid", F.explode("runs").alias("r")).select("rid", "r.*")
    # stored, so that both sides of the join are dealt for it and a gram with many rows can be split
    twice = stored(runs.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", (F.col("n") > GROUP).alias("often")), "twice")
    again = runs.join(twice, "h").groupBy("rid").agg(F.collect_list(F.struct("at", "a", "b", "often")).alias("runs"))
    # second pass: blocks of neighbouring windows, by their common core
    wanted = again.join(ones, "rid")
    same = (F.col("id").eqNullSafe(F.col("one_id"))) & (F.col("digest") == F.col("one_digest"))
    fetched = texts.join(wanted.hint("shuffle_hash"), same).select("rid", "data", "runs")
    salt = F.when(F.col("often"), F.xxhash64("rid", "at"))  # frequent rows aren't grouped here
    dealt = fetched.mapInArrow(blocks(length), DEALT).repartition(tasks(df), "k1", "k2", salt).sortWithinPartitions("k1", "k2")
    # third pass: windows of equal cores
    found = stored(dealt.mapInArrow(equal_groups, STARTS).select("rid", "first", "last", *[c.split()[0] for c in BLOCKS.split(", ") if not c.startswith("rid")]), "starts")
    starts, large = found.filter("first is not null").select("rid", "first", "last"), found.filter("first is null")
    if not large.isEmpty():
        starts = starts.unionAll(single_windows(large))
    of_text = starts.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    # a text with copies goes whole if it has a window; others lose their spans
    rows = scanned.select("rid", "id", "n_bytes", "digest", "sha").join(distinct.select("digest", "copies"), "digest")
    rows = stored(rows.join(of_text, "rid", "left"), "rows")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    no_spans = F.array().cast("array<struct<start:int,end:int>>")
    all_bytes = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    plain = rows.filter(whole | F.col("starts").isNull()).select("id", "n_bytes", F.when(whole, all_bytes).otherwise(no_spans).alias("spans"), F.when(whole, F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))).otherwise(F.col("sha")).alias("kept"))
    partly = rows.filter(~whole & F.col("starts").isNotNull()).select(F.col("id").alias("one_id"), F.col("digest").alias("one_digest"), "n_bytes", "starts")
    cut = texts.join(partly.hint("shuffle_hash"), same).select("id", "n_bytes", "data", "starts").mapInArrow(cut_batches(length), f"id {id_type}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return plain.unionAll(cut).select(F.col("id").alias(id_col), "n_bytes", "spans", F.lower(F.hex("kept")).alias("kept_sha256"))
