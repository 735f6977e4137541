"""Table changes as functions from frames to frames: the result is the new state of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precedence(rich: DataFrame, weak: DataFrame, keys: list[str]) -> DataFrame:
    """All of rich, and of weak what has no such key in rich."""
    return rich.unionByName(weak.join(rich.select(*keys), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones with the same key."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows go in only where their key is not there yet; repeats within new count once."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: list[str], overwrite: list[str] | None = None) -> DataFrame:
    """New values win where they are not null; columns in overwrite are taken from new rows as they are."""
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in values])
    b = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in values], F.lit(True).alias("__is_new"))
    both = a.join(b, keys, "full")
    pick = lambda c: F.when(F.col("__is_new"), F.col(f"__new_{c}")).otherwise(F.col(f"__old_{c}")) if c in (overwrite or []) else F.coalesce(f"__new_{c}", f"__old_{c}")
    return both.select(*keys, *[pick(c).alias(c) for c in values])


def fill_only(old: DataFrame, new: DataFrame, keys: list[str], fill: list[str], overwrite: list[str]) -> DataFrame:
    """Old rows with null columns of fill filled, columns of overwrite replaced where new has a value, and whether anything changed."""
    b = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in fill + overwrite])
    both = old.join(b, keys, "left")
    value = {c: F.coalesce(F.col(c), f"__new_{c}") for c in fill} | {c: F.coalesce(f"__new_{c}", F.col(c)) for c in overwrite}
    changed = F.lit(False)
    for c, v in value.items():
        changed = changed | ~v.eqNullSafe(F.col(c))
    return both.select(*[c for c in old.columns if c not in value], *[v.alias(c) for c, v in value.items()], changed.alias("changed"))


def scd2(current: DataFrame, incoming: DataFrame, key: str, tracked: list[str], day: Column) -> DataFrame:
    """History after one day's rows: (key, tracked, effective_from, effective_to, is_current, change).

    current holds open rows: key, tracked, effective_from. Same values stay open; other values close the old row on the day and open a
    new one; unknown keys open; keys that did not come stay as they are. change names the tracked columns that differ.
    """
    a = current.select(key, *[F.col(c).alias(f"__old_{c}") for c in tracked], "effective_from")
    b = incoming.select(key, *[F.col(c).alias(f"__new_{c}") for c in tracked], F.lit(True).alias("__came"))
    both = a.join(b, key, "full")
    known, came = F.col("effective_from").isNotNull(), F.coalesce("__came", F.lit(False))
    differs = [~F.col(f"__old_{c}").eqNullSafe(F.col(f"__new_{c}")) for c in tracked]
    moved = F.lit(False)
    for d in differs:
        moved = moved | d
    names = F.array_join(F.filter(F.array(*[F.when(d, F.lit(f"{c}_change")) for d, c in zip(differs, tracked, strict=True)]), lambda x: x.isNotNull()), ",")
    row = lambda side, start, end, open_, change: F.struct(*[F.col(f"__{side}_{c}").alias(c) for c in tracked], start.alias("effective_from"), end.alias("effective_to"), F.lit(open_).alias("is_current"), change.alias("change"))
    none, day_type = F.lit(None), current.schema["effective_from"].dataType
    none = none.cast(day_type)
    kept = row("old", F.col("effective_from"), none, True, F.lit("unchanged"))
    closed = row("old", F.col("effective_from"), day.cast(day_type), False, names)
    opened = row("new", day.cast(day_type), none, True, F.when(known, names).otherwise("new"))
    out = F.when(~known, F.array(opened)).when(~came | ~moved, F.array(kept)).otherwise(F.array(closed, opened))
    return both.select(key, F.explode(out).alias("r")).select(key, "r.*")


def scd2_history(history: DataFrame, incoming: DataFrame, key: str, tracked: list[str], day: Column) -> DataFrame:
    """A history of (key, tracked, effective_from, effective_to, is_current, change) after one day's rows: closed rows stay as they are, open ones go on by scd2."""
    current = history.filter("is_current").select(key, *tracked, "effective_from")
    return history.filter("not is_current").unionByName(scd2(current, incoming, key, tracked, day))


def snapshot_intervals(rows: DataFrame, snapshots: DataFrame, key: str, day: str) -> DataFrame:
    """Open and closed states from dated snapshots: (key, reported, resolved) for each run of consecutive snapshots that list the key.

    snapshots has every snapshot's day once; resolved is the first day without the key, null if it is on the last one.
    """
    w = Window.orderBy(day)
    days = snapshots.select(day).distinct().withColumn("__n", F.row_number().over(w)).withColumn("__next", F.lead(day).over(w))
    seen = rows.select(key, day).distinct().join(days, day)
    own = Window.partitionBy(key).orderBy("__n")
    runs = seen.withColumn("__run", F.col("__n") - F.row_number().over(own))
    return runs.groupBy(key, "__run").agg(F.min(day).alias("reported"), F.max_by("__next", "__n").alias("resolved")).drop("__run")


def changed_only(latest: DataFrame, incoming: DataFrame, key: str, same: Column) -> DataFrame:
    """Incoming rows whose payload differs from the latest stored one; same compares the columns `payload` and `__last`."""
    return incoming.join(latest.select(key, F.col("payload").alias("__last")), key, "left").filter(F.col("__last").isNull() | ~same).drop("__last")
