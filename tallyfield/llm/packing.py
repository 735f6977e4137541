"""Operator 4: best-fit packing into sequences of several permitted lengths.

Texts become pieces of at most the largest length. Pieces are dealt by a hash to groups of about GROUP_ROWS, a bounded size, and each
group is packed in one task: longest first, each into the open bin with the least room that holds it. A piece that fits nowhere opens a
bin. Its length is chosen then, jointly with what still waits: for each permitted length the bin is filled in thought with the largest waiting
pieces that fit, downsized to the least length that holds them, and the least cost a token wins. So lengths mix by demand. Last, every bin is downsized
to the least permitted length that holds its contents. Packings with one least length for all new bins are costed too, and the
cheapest of all counts. Groups are alike, as a hash deals them, so what they lose against one global packing is a few partly filled bins each.

Texts without tokens have one row with null bin, capacity and offset. Null ids and repeated rows are packed like any other: rows with the same
id and size are counted first and dealt one by one, so no id is a group, and the packing doesn't depend on how rows lie. Ties go
by id, then piece. An empty table gives none. Extra columns stay out.
"""

from __future__ import annotations

import bisect
import collections

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

GROUP_ROWS = 20_000
LENGTHS = (512, 1024, 2048, 4096, 8192)


def default_cost(length: int) -> float:
    """Of training on one sequence: in proportion to its length, with a share for attention that grows with it, and a fixed part."""
    return 16 + length * (1 + length / 65536)


def in_thought(size: int, length: int, waiting: dict[int, int], sizes: int) -> int:
    """What a new bin of a length would hold: a piece of `size`, then the largest waiting ones that fit. The bits of sizes are the sizes that wait."""
    room, most = length - size, length
    while room > 0 and (below := sizes & ((1 << min(room, most) + 1) - 1)):
        x = below.bit_length() - 1
        n = min(waiting[x], room // x)
        room, most = room - n * x, x - 1
    return length - room


def best_fit(sizes: list[int], lengths: tuple[int, ...], cost, floor: int | None = None) -> tuple[list[int], list[int], list[int]]:
    """Pack sizes, given in the order of packing: the bin and offset of each item, and the fill of each bin.

    A new bin has the length of the least cost a token, by what waits; with floor the least length that holds the item and floor.
    """
    waiting, left = collections.Counter(sizes), 0
    for x in waiting:
        left |= 1 << x
    price = [cost(c) for c in lengths]
    open_at: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    rooms, room, fill, bins, offsets = 0, [], [], [], []
    for size in sizes:
        waiting[size] -= 1
        if not waiting[size]:
            left ^= 1 << size
        fits = rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = open_at[r].pop()
            if not open_at[r]:
                rooms ^= 1 << r
        else:
            b = len(room)
            if floor is None:
                held = {c: in_thought(size, c, waiting, left) for c in lengths if c >= size}
                r = min(held, key=lambda c: (price[bisect.bisect_left(lengths, held[c])] / held[c], c))
            else:
                r = next(c for c in lengths if c >= size and c >= floor)
            room.append(r)
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += size
        r -= size
        if r:
            open_at[r].append(b)
            rooms |= 1 << r
    return bins, offsets, fill


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, cost=default_cost) -> tuple[list[int], list[int], list[int]]:
    """The cheapest packing: bin and offset of each item, and the downsized length of each bin."""
    ladder, best = np.array(lengths), None
    price = np.array([cost(c) for c in lengths])
    for floor in (None, *lengths):
        bins, offsets, fill = best_fit(sizes, lengths, cost, floor)
        step = np.searchsorted(ladder, fill)
        total = float(price[step].sum())
        if best is None or total < best[0]:
            best = (total, bins, offsets, ladder[step].tolist())
    return best[1:]


def packed(lengths: tuple[int, ...], cost):
    def group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("id", "ascending"), ("piece", "ascending")])
        bins, offsets, capacity = pack(rows["size"].to_pylist(), lengths, cost)
        base = rows["deal"][0].as_py() << 32
        made = {"bin_id": pa.array([base + b for b in bins], pa.int64()), "capacity": pa.array([capacity[b] for b in bins], pa.int32()), "offset": pa.array(offsets, pa.int32())}
        return pa.table({c: rows[c] for c in ("id", "piece", "start", "size")} | made)

    return group


def best_fit_packing(df: DataFrame, size, lengths: tuple[int, ...] = LENGTHS, cost=default_cost, id_col: str = "doc_id") -> DataFrame:
    """(id, piece, start, size, bin_id, capacity, offset) for the pieces of each row; size is the column of its tokens."""
    small_batches(df.sparkSession)
    lengths = tuple(sorted(lengths))
    id_type, top = df.schema[id_col].dataType.simpleString(), lengths[-1]
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(size, F.lit(0)).cast("long").alias("tokens")).groupBy("id", "tokens").agg(F.count("*").alias("n"))
    items = stored(rows, "sizes").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    last = F.greatest(F.lit(0), F.ceil(F.col("tokens") / top).cast("int") - 1)
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("start", F.col("piece").cast("long") * top)
    pieces = pieces.withColumn("size", F.least(F.col("tokens") - F.col("start"), F.lit(top)).cast("int"))
    full = pieces.filter("size > 0")
    groups = max(1, -(-full.count() // GROUP_ROWS))
    dealt = full.withColumn("deal", F.pmod(F.xxhash64("id", "tokens", "copy", "piece"), F.lit(groups))).select("deal", "id", "piece", "start", "size")
    # more tasks than 4096 would only be smaller ones; every group is in one of them
    out = dealt.repartition(min(4 * groups, 4096), "deal").groupBy("deal").applyInArrow(packed(lengths, cost), f"id {id_type}, piece int, start long, size int, bin_id long, capacity int, offset int")
    none = pieces.filter("size = 0").select("id", "piece", "start", "size", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("int").alias("offset"))
    return out.unionByName(none).withColumnRenamed("id", id_col)
