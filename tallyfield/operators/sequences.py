"""Spans and runs within one source, where state crosses rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_spans(df: DataFrame, duration: str, width: float, hop: float) -> DataFrame:
    """Spans of `width` every `hop`, and a last one at the end if they don't reach it; one short span for a short duration."""
    d = F.col(duration)
    steps = F.ceil((d - width) / hop).cast("int")
    ks = F.when(d <= width, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), steps))
    rows = df.withColumn("__k", F.explode(ks)).withColumn("start_s", F.col("__k") * hop)
    return rows.withColumn("end_s", F.least(F.col("start_s") + width, d)).drop("__k")


def find_run(df: DataFrame, keys: list[str], pos: str, coverage: str, least: float, total: float) -> DataFrame:
    """The best run of positions per key: rows covered by `least` or more, at most one uncovered row between them, the greatest sum of coverage, `total` or more; the first one on ties."""
    hits = df.filter(F.col(coverage) >= least)
    w = Window.partitionBy(*keys).orderBy(pos)
    new = F.coalesce(F.col(pos) - F.lag(pos).over(w) > 2, F.lit(True))
    runs = hits.withColumn("__run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = runs.groupBy(*keys, "__run").agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.round(F.sum(coverage), 9).alias("score"))
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "first_pos")
    return per.filter(F.col("score") >= total).withColumn("__rn", F.row_number().over(best)).filter("__rn = 1").drop("__rn", "__run")


def grouped(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over the rows of each key, one source or document at a time: its rows must fit a task."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def smooth_labels(labels: list, most: int) -> list:
    """Runs of up to `most` rows between two runs of one equal label take that label; repeated until nothing changes."""
    return [x for x, n in smooth_runs([(x, 1) for x in labels], most) for _ in range(n)]


def smooth_runs(runs: list[tuple], most: int) -> list[tuple]:
    """smooth_labels on runs (label, rows), the first one that can be absorbed before the others."""
    out: list[list] = []
    waiting = [list(r) for r in reversed(runs)]
    while waiting:
        x = waiting.pop()
        if out and out[-1][0] == x[0]:
            out[-1][1] += x[1]
        else:
            out.append(x)
        if waiting and waiting[-1][0] == out[-1][0]:
            continue  # the run isn't over
        while len(out) > 2 and out[-3][0] == out[-1][0] and out[-2][1] <= most:
            c, b = out.pop(), out.pop()
            out[-1][1] += b[1] + c[1]
    return [tuple(r) for r in out]


def smoothed(df: DataFrame, key: str, order: list[str], label: str, most: int) -> DataFrame:
    """(key, order, label): smooth_labels of each key's rows, streamed in order.

    A run of more than `most` rows is never absorbed, so what stands before it is settled and leaves; a task holds the rows since then.
    """
    names = [key, *order, label]

    def over(batches):
        held: list[tuple] = []  # rows not yet settled, of one key
        runs: list[list] = []  # their runs, the first one perhaps begun before them

        def settled(last: bool):
            """Rows of the runs before the last long one, and of that; all of them at the end of a key."""
            nonlocal held, runs
            at = len(runs) if last else next((k for k in range(len(runs) - 2, -1, -1) if runs[k][1] > most), -1) + 1
            if not at:
                return []
            before = runs[0][1] - runs[0][2]  # rows of the first run that have left
            labels = [x for x, n in smooth_runs([(r[0], r[1]) for r in runs[:at]], most) for _ in range(n)][before:]
            out = [(*row[:-1], x) for row, x in zip(held, labels, strict=False)]
            held = held[len(labels) :]
            runs = [] if last else [[runs[at - 1][0], runs[at - 1][1], 0], *runs[at:]]
            return out

        now, first = None, True
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if first or row[0] != now:
                    out += settled(True) if held else []
                    now, first, runs = row[0], False, []
                if runs and runs[-1][0] == row[-1]:
                    runs[-1][1] += 1
                    runs[-1][2] += 1
                else:
                    runs.append([row[-1], 1, 1])
                held.append(row)
            out += settled(False) if len(held) > 1000 else []
            yield table(b.schema, out)
        if held:
            yield table(schema[0], settled(True))

    schema = [None]

    def table(kind, rows):
        schema[0] = kind
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(kind), kind, strict=True)], schema=kind)

    rows = df.select(*names).repartition(key).sortWithinPartitions(key, *order)
    return rows.mapInArrow(over, rows.schema)


def smooth_spans(spans: list[tuple], short: float, gap: float) -> list[tuple]:
    """A-B-A of (label, start, end, text) becomes one A if B is shorter than `short` and both gaps are at most `gap`; texts are joined."""
    out = list(spans)
    k = 1
    while k < len(out) - 1:
        a, b, c = out[k - 1 : k + 2]
        if a[0] == c[0] != b[0] and b[2] - b[1] < short and b[1] - a[2] <= gap and c[1] - b[2] <= gap:
            out[k - 1 : k + 2] = [(a[0], a[1], c[2], " ".join(x[3] for x in (a, b, c) if x[3]))]
            k = max(1, k - 1)
        else:
            k += 1
    return out


def thin_boundaries(scored: list[tuple[int, float]], least_block: int, n: int) -> list[int]:
    """Boundary positions in order, each at least `least_block` after the one before and before the end; of two too near the higher score stays."""
    kept: list[tuple[int, float]] = []
    for pos, score in scored:
        if pos < least_block or n - pos < least_block:
            continue
        if kept and pos - kept[-1][0] < least_block:
            if score > kept[-1][1]:
                kept[-1] = (pos, score)
            continue
        kept.append((pos, score))
    return [p for p, _ in kept]


def dominant(counts: dict, least: int) -> list:
    """Topics mentioned in `least` sentences or more, the most frequent first."""
    return [x for x, n in sorted(counts.items(), key=lambda p: (-p[1], p[0])) if n >= least]


def keep_longer(df: DataFrame, keys: list[str], group: str, text: str) -> DataFrame:
    """df's rows with the longest text of their keys, those of the first group that has one; also_in lists the other groups of the keys."""
    size = F.length(text)
    best = df.groupBy(*keys).agg(F.max(F.struct(size.alias("n"), (-F.col(group)).alias("g"))).alias("__b"), F.collect_set(group).alias("__groups"))
    kept = df.join(best, keys).filter((size == F.col("__b.n")) & (F.col(group) == -F.col("__b.g")))
    return kept.withColumn("also_in", F.array_sort(F.array_remove("__groups", F.col(group)))).drop("__b", "__groups")
