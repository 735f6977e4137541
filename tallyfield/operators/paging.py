"""Sorting by request, pages, cursors and samples."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_by(df: DataFrame, name: str, allowed: dict[str, Column], unique: str) -> DataFrame:
    """df in the order of an allowed name, or of the first one for any other; ties by a unique column."""
    return df.orderBy(allowed.get(name) if name in allowed else next(iter(allowed.values())), unique)


#: Ranges that an order is cut into, rows whose order columns are looked at to cut it, and rows that are sorted for a page at most, unless they are equal.
RANGES, SAMPLED, SORTED = 128, 4096, 50_000


class Order:
    """Columns in order, ascending with nulls first, or descending with nulls last if the name begins with a minus, as Spark sorts them."""

    def __init__(self, names: list[str]):
        self.names = [n.removeprefix("-") for n in names]
        self.down = [n.startswith("-") for n in names]

    def columns(self) -> list[Column]:
        return [F.desc(n) if down else F.asc(n) for n, down in zip(self.names, self.down, strict=True)]

    def before(self, bound: tuple) -> Column:
        """Whether a row comes before one with these values."""
        out, equal = F.lit(False), F.lit(True)
        for name, down, value in zip(self.names, self.down, bound, strict=True):
            c = F.col(name)
            if value is None:
                less = c.isNotNull() if down else F.lit(False)
                same = c.isNull()
            else:
                less = F.coalesce(c > F.lit(value), F.lit(False)) if down else c.isNull() | (c < F.lit(value))
                same = F.coalesce(c == F.lit(value), F.lit(False))
            out = out | equal & less
            equal = equal & same
        return out


class Pages:
    """The rows of df by page, in an order, which should end with a unique column.

    The order is cut into ranges at values of rows chosen by hash, and one pass counts each range: their sum is the number of all rows. A page then reads and sorts the rows of its ranges only; a range of
    more than SORTED rows is cut again first. So neither a deep page nor the total sorts the table or gathers it in one task. Rows equal in all order columns are never parted, so many of those are sorted together.
    """

    def __init__(self, df: DataFrame, order: list[str], parts: int = RANGES):
        self.df, self.names, self.order, self.parts = df, order, Order(order), parts
        keys = df.select(*self.order.names)
        chosen = keys.orderBy(F.xxhash64(*self.order.names)).limit(SAMPLED)
        found = [tuple(r) for r in chosen.distinct().orderBy(*self.order.columns()).collect()]
        self.bounds = [found[k * len(found) // parts] for k in range(1, parts) if k * len(found) // parts < len(found)] if len(found) > 1 else []
        self.bounds = [b for k, b in enumerate(self.bounds) if not k or b != self.bounds[k - 1]]
        part = sum((1 - self.order.before(b).cast("int") for b in self.bounds), F.lit(0))
        counted = {r["part"]: r["n"] for r in keys.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
        self.counts = [counted.get(k, 0) for k in range(len(self.bounds) + 1)]
        self.total = sum(self.counts)

    def between(self, first: int, last: int) -> DataFrame:
        """The rows of the ranges first to last."""
        rows = self.df
        if first:
            rows = rows.filter(~self.order.before(self.bounds[first - 1]))
        return rows.filter(self.order.before(self.bounds[last])) if last < len(self.bounds) else rows

    def page(self, limit: int, offset: int) -> DataFrame:
        """`limit` rows from place `offset` on, in order; fewer at the end."""
        if limit <= 0 or offset >= self.total:
            return self.df.limit(0)
        ends = list(accumulate(self.counts))
        first, last = bisect_right(ends, offset), min(bisect_left(ends, offset + limit), len(ends) - 1)
        skipped = ends[first] - self.counts[first]
        rows, inside = self.between(first, last), offset - skipped
        if first == last and self.counts[first] > SORTED and self.bounds:
            return Pages(rows, self.names, self.parts).page(limit, inside)
        return rows.orderBy(*self.order.columns()).offset(inside).limit(limit)


def page(df: DataFrame, order: list[str], limit: int, offset: int) -> tuple[DataFrame, int]:
    """A page and the number of all rows, both from the counts of ranges."""
    pages = Pages(df, order)
    return pages.page(limit, offset), pages.total


def before(df: DataFrame, ts: str, unique: str, cursor: str, limit: int) -> DataFrame:
    """The newest rows before a cursor, and whether there are more: one row beyond the limit tells."""
    rows = df.filter(F.col(ts) < F.lit(cursor).cast("timestamp")).orderBy(F.desc(ts), F.desc(unique)).limit(limit + 1)
    more = len(rows.select(unique).take(limit + 1)) > limit
    return rows.limit(limit).withColumn("has_more", F.lit(more))


def seeded_sample(df: DataFrame, unique: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows, or all if fewer, the same on each run."""
    return df.orderBy(F.xxhash64(F.col(unique), F.lit(seed)), unique).limit(n)


def optional(df: DataFrame, equal: dict, score: str, least) -> DataFrame:
    for c, v in equal.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df if least is None else df.filter(F.col(score) >= least)
