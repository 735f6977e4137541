"""Joins on time and intervals, keyed so that they shuffle on equality; and lookups with fallbacks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, payload: list[str], order: list[str] | None = None, piece: Column | None = None) -> DataFrame:
    """left with the payload of the last right row at or before it, per key; null without one.

    One union and one window: each key is sorted once, and right rows come before left rows of the same time. The names in order, of
    right, decide among right rows of the same time. Where a key may have very many rows, `piece` cuts its time: an expression of the column
    `__ts` that grows with it, such as a day. Then a task sorts one piece of one key, and what a piece hasn't comes from the last right row of
    the pieces before it, one row a piece.
    """
    width = F.struct(*[F.col(c) for c in payload])
    tie = F.struct(*[F.col(c) for c in order]) if order else F.struct(F.lit(0).alias("z"))
    cut = piece if piece is not None else F.lit(0)
    rows = right.select(*keys, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), tie.alias("__tie"), width.alias("__hit"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__row"))
    own = left.select(*keys, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast(rows.schema["__tie"].dataType).alias("__tie"), F.lit(None).cast(rows.schema["__hit"].dataType).alias("__hit"), F.struct("*").alias("__row"))
    both = rows.unionAll(own).withColumn("__piece", cut)
    w = Window.partitionBy(*keys, "__piece").orderBy("__ts", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__hit", ignorenulls=True).over(w)).filter("__side = 1")
    if piece is not None:
        newest = both.groupBy(*keys, "__piece").agg(F.max_by("__hit", F.when(F.col("__side") == 0, F.struct("__ts", "__tie"))).alias("__newest"))
        before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
        carried = newest.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], F.col("__piece").alias("__of"), F.last("__newest", ignorenulls=True).over(before).alias("__before"))
        on = F.col("__piece").eqNullSafe(F.col("__of"))
        for n, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"__k{n}"))
        found = found.join(carried, on, "left").withColumn("__last", F.coalesce("__last", "__before"))
    return found.select("__row.*", *[F.col(f"__last.{c}").alias(c) for c in payload])


#: Cells of a level that an interval spans at most, one more at its ends; cells of the next level are so many times as wide.
CELLS = 8


def _level(start: str, end: str, width: float, longest: float | None) -> Column:
    """The least level at which an interval spans up to CELLS cells."""
    length = F.col(end) - F.col(start)
    level = F.when(length <= CELLS * width, 0).otherwise(F.ceil(F.log(float(CELLS), length / width) - 1e-9) - 1).cast("int")
    return level if longest is None else F.when(length > longest, F.raise_error(F.lit("an interval is longer than `longest`")).cast("int")).otherwise(level)


def _levels(sides: list[tuple[DataFrame, str, str]], width: float, longest: float | None) -> tuple[DataFrame | None, Column]:
    """The levels in use: from the intervals themselves, as one row to be joined, or without reading them if `longest` bounds them."""
    if longest is not None:
        most = 0
        while longest > CELLS ** (most + 1) * width:
            most += 1
        return None, F.array(*[F.lit(k) for k in range(most + 1)])
    rows = None
    for k, (df, start, end) in enumerate(sides):
        own = df.filter(F.col(start) <= F.col(end)).agg(F.collect_set(_level(start, end, width, None)).alias(f"__levels{k}"))
        rows = own if rows is None else rows.crossJoin(own)
    every = F.array_distinct(F.concat(*[F.col(f"__levels{k}") for k in range(len(sides))]))
    return rows.select(every.alias("__levels")), F.col("__levels")


def _cell(value: Column, level: str, width: float) -> Column:
    return F.floor(value / (F.pow(F.lit(float(CELLS)), F.col(level)) * width)).cast("long")


def _joined_keys(df: DataFrame, keys: list[str], drop: list[str], level: str, cell: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in df.columns if c not in keys and c not in drop], F.col("__level").alias(level), F.col("__cell").alias(cell))


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: float, closed: bool = True, longest: float | None = None) -> DataFrame:
    """Points with every interval of the same keys that holds them: [start, end], or [start, end) unless closed.

    Times are numbers. Intervals are spread over cells, of `width` or of a power of CELLS times it, so that each is in few, however long it is;
    a point has one cell of each width in use. So the join is on equality of keys and cell, whatever the number of intervals of a key, and no
    pair comes twice. `longest` bounds the intervals' lengths where it is known, which saves reading them for the widths; a longer one is an error.
    """
    rows, levels = _levels([(intervals, start, end)], width, longest)
    spread = intervals.filter(F.col(start) <= F.col(end)).withColumn("__level", _level(start, end, width, longest))
    spread = spread.withColumn("__cell", F.explode(F.sequence(_cell(F.col(start), "__level", width), _cell(F.col(end), "__level", width))))
    own = (points if rows is None else points.crossJoin(rows)).withColumn("__plevel", F.explode(levels)).withColumn("__pcell", _cell(F.col(at), "__plevel", width))
    inside = (F.col(at) >= F.col(start)) & ((F.col(at) <= F.col(end)) if closed else (F.col(at) < F.col(end)))
    on = inside & (F.col("__pcell") == F.col("__icell")) & (F.col("__plevel") == F.col("__ilevel"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    found = own.join(_joined_keys(spread, keys, ["__cell", "__level"], "__ilevel", "__icell"), on)
    return found.drop("__levels", "__plevel", "__pcell", "__ilevel", "__icell", *[f"__{k}" for k in keys])


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """df in as many tasks as the session shuffles to, few bytes or not: what a task makes of its rows can be far more than it reads."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _present(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.filter(F.col(name).isNotNull())
    return df


def first_interval(points: DataFrame, intervals: DataFrame, keys: list[str], point_id: list[str], at: str, start: str, end: str, width: float, closed: bool = True, tie: list[str] | None = None, longest: float | None = None) -> DataFrame:
    """Each point with the first interval that holds it, by start and the names in tie; points without one drop out.

    Both sides meet in cells as in range_join, but no pairs are made. Of the intervals of a cell, in order, only those that end after all
    before them can be first; their ends rise, so a point's first one is that with the least end after it, if it has begun by then. Two
    windows over one shuffle find it, each in time of its rows, and a point has one candidate for each width in use.
    """
    rows, levels = _levels([(intervals, start, end)], width, longest)
    hit = F.struct(*[c for c in intervals.columns if c not in keys])
    held = _present(intervals, *keys).filter(F.col(start) <= F.col(end)).withColumn("__level", _level(start, end, width, longest))
    held = held.select(*keys, "__level", F.explode(F.sequence(_cell(F.col(start), "__level", width), _cell(F.col(end), "__level", width))).alias("__cell"), F.col(end).alias("__time"), hit.alias("__hit"), F.lit(None).cast(points.schema).alias("__row"))
    own = _present(points, *keys, at).select(*keys, F.col(at).alias("__time"), F.struct("*").alias("__row"))
    own = (own if rows is None else own.crossJoin(rows)).withColumn("__level", F.explode(levels))
    own = own.select(*keys, "__level", _cell(F.col("__time"), "__level", width).alias("__cell"), "__time", F.lit(None).cast(held.schema["__hit"].dataType).alias("__hit"), "__row")
    both, cell = _dealt(held.unionAll(own), *keys, "__level", "__cell"), Window.partitionBy(*keys, "__level", "__cell")
    before = cell.orderBy(*[F.col(f"__hit.{c}") for c in [start, *(tie or [])]]).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max(F.when(F.col("__row").isNull(), F.col("__time"))).over(before)
    both = both.withColumn("__ended", ended).filter("__row IS NOT NULL OR __ended IS NULL OR __ended < __time")
    side = F.when(F.col("__row").isNull(), 0 if closed else 1).otherwise(1 if closed else 0)
    down = cell.orderBy(F.desc("__time"), side).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__hit", F.last("__hit", ignorenulls=True).over(down)).filter(F.col("__row").isNotNull() & (F.col(f"__hit.{start}") <= F.col("__time")))
    w = Window.partitionBy(*point_id).orderBy(start, *(tie or []))
    return found.select("__row.*", "__hit.*").withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: float, touching: bool = True, longest: float | None = None) -> DataFrame:
    """Pairs of intervals of the same keys that overlap; touching ends count if `touching`.

    Both sides are spread over cells as in range_join, each at its own width and at all wider ones in use. A pair is kept only at the
    wider one of its two, in the cell in which its overlap begins, so it comes once.
    """
    (s1, e1), (s2, e2) = a_span, b_span
    rows, levels = _levels([(a, s1, e1), (b, s2, e2)], width, longest)

    def spread(df, start, end, own):
        df = df.filter(F.col(start) <= F.col(end)).withColumn(own, _level(start, end, width, longest))
        df = (df if rows is None else df.crossJoin(rows)).withColumn("__level", F.explode(F.filter(levels, lambda x: x >= F.col(own))))
        return df.withColumn("__cell", F.explode(F.sequence(_cell(F.col(start), "__level", width), _cell(F.col(end), "__level", width)))).drop("__levels")

    left = spread(a, s1, e1, "__own")
    right = _joined_keys(spread(b, s2, e2, "__other"), keys, ["__cell", "__level"], "__ilevel", "__icell")
    meet = (F.col(s1) <= F.col(e2)) & (F.col(e1) >= F.col(s2)) if touching else (F.col(s1) < F.col(e2)) & (F.col(e1) > F.col(s2))
    on = meet & (F.col("__cell") == F.col("__icell")) & (F.col("__level") == F.col("__ilevel")) & (F.col("__level") == F.greatest("__own", "__other")) & (F.col("__cell") == _cell(F.greatest(s1, s2), "__level", width))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return left.join(right, on).drop("__level", "__cell", "__ilevel", "__icell", "__own", "__other", *[f"__{k}" for k in keys])


#: Cells of _beside are so many times as wide as the longest interval.
WIDE = 2


def _beside(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], longest: float, tie: str | None):
    """Rows of both, grouped by keys and cell: a row of a is in the cell of its start, one of b in each cell where a row of a that meets it can start.

    No interval may be longer than `longest`, so a row of b is in two cells at most, and rows grow with the tables, not with their pairs.
    Times of both have one type. Keys, times and tie are columns of their own, other columns come as __a and __b, see _taken.
    """
    near = longest * 1.001
    cell = lambda c: F.floor(c / (WIDE * near)).cast("long")

    def fit(df, start, end):
        longer = F.raise_error(F.lit("an interval is longer than `longest`")).cast("boolean")
        return _present(df, *keys).filter(F.when(F.col(end) - F.col(start) > longest, longer).otherwise(F.col(start) <= F.col(end)))

    def others(df, *apart):
        return F.struct(F.lit(0).cast("byte").alias("__row"), *[c for c in df.columns if c not in keys and c not in apart])

    (s1, e1), (s2, e2) = a_span, b_span
    order = F.col(tie) if tie else F.lit(0)
    own, other = fit(a, s1, e1), fit(b, s2, e2)
    of_a, of_b = others(a, s1, e1), others(b, s2, e2, tie)
    none = lambda df, column: F.lit(None).cast(df.select(column).schema[0].dataType)
    own = own.select(*keys, cell(F.col(s1)).alias("__cell"), F.col(s1).alias("__s"), F.col(e1).alias("__e"), none(b, order).alias("__tie"), of_a.alias("__a"), none(b, of_b).alias("__b"))
    other = other.select(*keys, F.explode(F.sequence(cell(F.col(s2) - near), cell(F.col(e2)))).alias("__cell"), F.col(s2).alias("__s"), F.col(e2).alias("__e"), order.alias("__tie"), none(a, of_a).alias("__a"), of_b.alias("__b"))
    return _dealt(own.unionAll(other), *keys, "__cell").groupBy(*keys, "__cell")


def _sides(batches) -> tuple[pa.Table, pa.Table] | None:
    """Rows of a and of b of a group of _beside, in order; None if one has none."""
    rows = pa.Table.from_batches(list(batches)).combine_chunks()
    own = pc.is_valid(rows.column("__a"))
    a, b = rows.filter(own), rows.filter(pc.invert(own))
    return a.sort_by("__s").combine_chunks(), b.sort_by([("__s", "ascending"), ("__tie", "ascending")]).combine_chunks()


def _taken(rows: pa.Table, side: str, names: list[str], keys: list[str], span: tuple[str, str], tie: str | None = None) -> list[pa.Array]:
    """The columns `names` of a (side __a) or b (__b), of rows of _beside."""
    apart = dict(zip([*span, tie], ["__s", "__e", "__tie"], strict=True))
    found = [rows.column(c) if c in keys else rows.column(apart[c]) if c in apart else pc.struct_field(rows.column(side), c) for c in names]
    return [c.combine_chunks() for c in found]


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


#: Characters of joined items that a batch holds before it is passed on.
BATCH = 1 << 23


def overlap_texts(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], item: str, tie: str, separator: str, longest: float) -> DataFrame:
    """Rows of a with `text`, the strings in the column item of all rows of b that overlap them, by start and tie, and `n`, how many rows these are.

    Ends that touch count. Null items are counted, but not joined; without any item the text is null. All rows of a stay. What is shuffled
    grows with the tables; the texts themselves are as long as they are, and go out as they are made, in order of start in a cell: texts
    of neighbours share most of their words, which a compressing writer can use.
    """
    (s1, e1), ends = a_span, T.StructType([*a.schema.fields, T.StructField("text", T.StringType()), T.StructField("n", T.LongType())])
    names = a.columns

    def joined(batches):
        a, b = _sides(batches)
        start, end, words = _numbers(b, "__s"), _numbers(b, "__e"), _taken(b, "__b", [item], keys, b_span, tie)[0].to_numpy(zero_copy_only=False)
        since, until, own = _numbers(a, "__s"), _numbers(a, "__e"), _taken(a, "__a", names, keys, a_span)
        first = np.searchsorted(np.maximum.accumulate(end), since) if len(end) else np.zeros(len(since), np.int64)
        last, gaps = np.searchsorted(start, until, side="right"), any(w is None for w in words)
        texts, counts, size, done = [], [], 0, 0
        for k, (lo, hi) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            found = words[lo:hi][end[lo:hi] >= since[k]].tolist()
            counts.append(len(found))
            found = [w for w in found if w is not None] if gaps else found
            texts.append(separator.join(found) if found else None)
            size += len(texts[-1] or "")
            if size >= BATCH or k + 1 == len(first):
                yield pa.RecordBatch.from_arrays([*[c.slice(done, len(texts)) for c in own], pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=[*names, "text", "n"])
                done, texts, counts, size = k + 1, [], [], 0

    held = b.select(*dict.fromkeys([*keys, *b_span, tie, item]))
    found = _beside(a, held, keys, a_span, b_span, longest, tie).applyInArrow(_streamed(joined), ends)
    gone = F.col(s1).isNull() | F.col(e1).isNull() | (F.col(s1) > F.col(e1))
    for k in keys:
        gone = gone | F.col(k).isNull()
    return found.unionAll(a.filter(gone).select("*", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n")))


def _streamed(of_group):
    """A function of a group's batches with the types that tell Spark that it takes and gives iterators."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from of_group(batches)

    over.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return over


def most_overlapping(s: np.ndarray, e: np.ndarray, t0: np.ndarray, t1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval [s, e] the number of that of [t0, t1], in order of t0, that overlaps it most, the first on ties, and by how much.

    The first one that ends at e or later is found in the running maximum of ends. If it starts by s, it holds [s, e] whole. If not, it
    overlaps more than any after it, and those before it end before e: of these, one that starts before s overlaps by how far it reaches,
    again a running maximum, and the others by their lengths, whose maximum over a range comes from a table of ranges of powers of two.
    """
    n = len(t0)
    reach, length = np.maximum.accumulate(t1), t1 - t0
    whole = np.searchsorted(reach, e)  # n, if none reaches e
    lo = np.searchsorted(t0, s)
    at = lambda values, k: values[np.clip(k, 0, n - 1)]
    table = [np.arange(n)]
    while 2 ** len(table) <= n:
        left, half = table[-1], 2 ** (len(table) - 1)
        a, b = left[:-half], left[half:]
        table.append(np.where(length[b] > length[a], b, a))
    best, most = np.full(len(s), -1), np.zeros(len(s), length.dtype)

    def take(k, overlap, where):  # in rising order of k, so that earlier ones stay on ties
        better = where & (overlap > most)
        best[better], most[better] = k[better], overlap[better]

    holds = (whole < n) & (at(t0, whole) <= s)
    take(whole, e - s, holds)
    take(np.searchsorted(reach, at(reach, lo - 1)), at(reach, lo - 1) - s, ~holds & (lo > 0))
    many = whole - lo
    for k, own in enumerate(table):
        on = np.flatnonzero(~holds & (many >= 1 << k) & (many < 2 << k))
        if len(on):
            a, b = own[lo[on]], own[whole[on] - (1 << k)]
            k_best = np.where(length[b] > length[a], b, a)
            better = length[k_best] > most[on]
            best[on[better]], most[on[better]] = k_best[better], length[k_best[better]]
    take(whole, e - at(t0, whole), ~holds & (whole < n))
    return best, most


def max_overlap(a: DataFrame, b: DataFrame, keys: list[str], a_id: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: float, longest: float | None = None, tie: str | None = None) -> DataFrame:
    """Each interval of a with the interval of b that overlaps it most, strictly; the earlier one on ties, then that of the least `tie`.

    Where `longest` bounds the lengths no pairs are made: see most_overlapping. Without it all pairs are, of which the greatest stay. Whole
    numbers, such as microseconds, are compared exactly.
    """
    (s1, e1), (s2, e2) = a_span, b_span
    w = Window.partitionBy(*a_id).orderBy(F.desc("overlap"), s2, *([tie] if tie else []))
    if longest is None:
        pairs = overlap_join(a, b, keys, a_span, b_span, width, touching=False).withColumn("overlap", F.least(e1, e2) - F.greatest(s1, s2))
        return pairs.filter("overlap > 0").withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    kept = [c for c in b.columns if c not in keys]
    fields = [*a.schema.fields, *[b.schema[c] for c in kept], T.StructField("overlap", a.select(F.col(e1) - F.col(s1)).schema[0].dataType)]
    names, a_names = [f.name for f in fields], a.columns

    def found(batches):
        a, b = _sides(batches)
        if not (len(a) and len(b)):
            return
        best, most = most_overlapping(*[_numbers(x, c) for x in (a, b) for c in ("__s", "__e")])
        on = np.flatnonzero(best >= 0)
        own, hit = a.take(pa.array(on)), b.take(pa.array(best[on]))
        yield pa.RecordBatch.from_arrays([*_taken(own, "__a", a_names, keys, a_span), *_taken(hit, "__b", kept, keys, b_span, tie), pa.array(most[on])], names=names)

    rows = _beside(a, b, keys, a_span, b_span, longest, tie).applyInArrow(_streamed(found), T.StructType(fields))
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def overlap_sums(a: DataFrame, b: DataFrame, keys: list[str], a_id: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int, touching: bool = True) -> DataFrame:
    """(a_id, n, total): how many intervals of b overlap those of a, and by how much in all; touching ends count if `touching`. Ids without any drop out.

    Times are whole numbers and intervals of any length. No pairs are made: those that overlap are those that start by the end less those
    that end before the start, and what they cover up to a time comes from running counts and sums. Time is cut into pieces of `width`,
    so that a task sums up pieces of a key; what is before a piece comes from sums of pieces, one row each.
    """
    (s1, e1), (s2, e2) = a_span, b_span
    a = _present(a, *keys).filter(F.col(s1) <= F.col(e1))
    b = _present(b, *keys).filter(F.col(s2) <= F.col(e2))
    ids = F.struct(*a_id)
    same_a, same_b = F.col(s1) == F.col(e1), F.col(s2) == F.col(e2)
    # the order at one time: starts of a before ends of b and starts of b before ends of a if touching, else the other way round; of
    # intervals without a length, a start of a comes between ends of long and of such intervals of b
    if touching:
        a_from, a_to, b_to, b_from = F.lit(0), F.lit(3), F.lit(1), F.lit(2)
    else:
        a_from, a_to, b_to, b_from = F.when(same_a, 1).otherwise(3), F.lit(4), F.when(same_b, 2).otherwise(0), F.lit(5)
    move = lambda t, order, sign, id_: F.struct(t.cast("long").alias("__t"), order.cast("int").alias("__order"), F.lit(sign).alias("__sign"), id_.alias("__id"))
    none = F.lit(None).cast(a.select(ids).schema[0].dataType)
    own = a.select(*keys, F.inline(F.array(move(F.col(s1), a_from, -1, ids), move(F.col(e1), a_to, 1, ids))))
    other = b.select(*keys, F.inline(F.array(move(F.col(s2), b_from, 1, none), move(F.col(e2), b_to, -1, none))))
    both = own.unionAll(other).withColumn("__piece", F.expr(f"__t div {int(width)}"))
    mine = F.col("__id").isNull()
    parts = {"__from": F.when(mine & (F.col("__sign") > 0), 1).otherwise(0).cast("long"), "__to": F.when(mine & (F.col("__sign") < 0), 1).otherwise(0).cast("long"), "__at": F.when(mine, F.col("__sign") * F.col("__t")).otherwise(0).cast("decimal(20,0)")}
    dealt = _dealt(both.select("*", *[v.alias(k) for k, v in parts.items()]), *keys, "__piece")
    w = Window.partitionBy(*keys, "__piece").orderBy("__t", "__order").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.select(*keys, "__piece", "__t", "__sign", "__id", *[F.sum(k).over(w).alias(k) for k in parts]).filter("__id IS NOT NULL")
    before = Window.partitionBy(*[f"__k{n}" for n in range(len(keys))]).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sums = both.groupBy(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], F.col("__piece").alias("__of")).agg(*[F.sum(v).alias(f"{k}_sum") for k, v in parts.items()])
    sums = sums.select(*[f"__k{n}" for n in range(len(keys))], "__of", *[F.sum(f"{k}_sum").over(before).alias(f"{k}_before") for k in parts])
    on = F.col("__piece") == F.col("__of")
    for n, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"__k{n}"))
    run = run.join(sums, on, "left")
    started, ended, moved = [(F.col(k) + F.coalesce(F.col(f"{k}_before"), F.lit(0))).cast("decimal(38,0)") for k in parts]
    covered = F.col("__t").cast("decimal(19,0)") * (started - ended).cast("decimal(18,0)") - moved
    many = F.when(F.col("__sign") > 0, started).otherwise(-ended)
    out = run.groupBy("__id").agg(F.sum(many).cast("long").alias("n"), F.sum(F.col("__sign") * covered.cast("decimal(38,0)")).cast("decimal(38,0)").alias("total"))
    return out.filter("n > 0").select("__id.*", "n", "total")


#: Parts into which salted_left deals the rows of a key.
SALTS = 32


def salted_left(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """left with all rows of right that have its keys, or nulls, where keys may be few and frequent: rows of left that share them go to SALTS tasks.

    The column `by` decides to which; right goes to all of them. So no task makes more than its share of the rows, which can be as many
    as the product of both sides.
    """
    own = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    other = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return _dealt(own, *keys, "__salt").join(_dealt(other, *keys, "__salt").hint("merge"), [*keys, "__salt"], "left").drop("__salt").select(*keys, *[c for c in [*left.columns, *right.columns] if c not in keys])


def lookup(df: DataFrame, dim: DataFrame, on: list[str], values: list[str], default=None) -> DataFrame:
    """df with values of a dimension; a miss gives null, or default. Spark broadcasts dim if it is small enough."""
    out = df.join(dim.select(*on, *values), on, "left")
    return out if default is None else out.fillna({v: default for v in values})


def cascade(df: DataFrame, steps: list[tuple[DataFrame, str, str, str]], name: str) -> DataFrame:
    """The first hit of several lookups: (dimension, key in df, key in dimension, value). Each dimension must have unique keys."""
    found = []
    for k, (dim, own, key, value) in enumerate(steps):
        df = df.join(dim.select(F.col(key).alias(f"__k{k}"), F.col(value).alias(f"__v{k}")), F.col(own) == F.col(f"__k{k}"), "left")
        found.append(f"__v{k}")
    return df.withColumn(name, F.coalesce(*found)).drop(*found, *[f"__k{k}" for k in range(len(steps))])
