"""Decision ladders, bounded scores and costs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS_ORDER = ["HEALTHY", "UNKNOWN", "WARN", "FAILED"]


def ladder(rules: list[tuple[Column, object]], default) -> Column:
    """The value of the first rule that holds."""
    out = F
    for condition, value in rules:
        out = out.when(condition, value)
    return out.otherwise(default)


def agreement(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), "none").when(a.isNull() | b.isNull(), "partial").when(a == b, "agree").otherwise("disagree")


def fuse(a: Column, a_score: Column, b: Column, b_score: Column) -> tuple[Column, Column]:
    """Identity and confidence from two sources: agreeing, their mean up to 1; single, that one; in conflict, null."""
    identity = F.when(a.eqNullSafe(b), a).when(b.isNull(), a).when(a.isNull(), b)
    confidence = F.when(a.eqNullSafe(b), F.least(F.lit(1.0), (a_score + b_score) / 2)).when(b.isNull(), a_score).when(a.isNull(), b_score)
    return identity, confidence


def worst_status(status: Column) -> Column:
    """Aggregate: the worst of statuses by STATUS_ORDER."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), status)
    return F.element_at(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.max(rank).cast("int"))


def exactly_one(*columns: Column) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + c.isNotNull().cast("int")
    return total == 1


def bounded_score(parts: list[tuple], relevant: Column, cap: float, most_reasons: int = 5) -> tuple[Column, Column]:
    """Sum of bonuses, capped where no relevance term is there, clamped to [0, 1]; and the reasons that hold.

    parts: (condition, bonus, reason); without a condition the bonus is a column.
    """
    total = F.lit(0.0)
    for condition, bonus, _ in parts:
        total = total + (bonus if condition is None else F.when(condition, F.lit(bonus)).otherwise(0.0))
    score = F.when(relevant, total).otherwise(F.least(total, F.lit(cap)))
    reasons = F.array(*[F.when(c, F.lit(r)) for c, _, r in parts if r])
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2), F.slice(F.filter(reasons, lambda x: x.isNotNull()), 1, most_reasons)


def keyword_labels(text: Column, words: dict[str, list[str]], most: int, fallback: str) -> Column:
    """Labels, in the order of words, any of whose keywords the text contains; the fallback alone without one."""
    found = []
    for label, keys in words.items():
        hit = F.lit(False)
        for k in keys:
            hit = hit | text.contains(k)
        found.append(F.when(hit, F.lit(label)))
    kept = F.slice(F.filter(F.array(*found), lambda x: x.isNotNull()), 1, most)
    return F.when(F.size(kept) == 0, F.array(F.lit(fallback))).otherwise(kept)


def token_cost(df: DataFrame, prices: DataFrame, tokens: str, default: float, cents: bool = False) -> DataFrame:
    """df with the cost of each row's tokens per million at its model's price, or the default price; in whole cents if `cents`."""
    priced = df.join(prices, "model", "left").withColumn("price", F.coalesce("price", F.lit(default)))
    if cents:
        return priced.withColumn("cents", (F.col(tokens) * F.col("price") * 100).cast("decimal(18,0)").cast("long"))
    return priced.withColumn("cost", F.col(tokens) / 1e6 * F.col("price"))


def month_end(spent: Column, day: Column) -> Column:
    """Spend at the end of the month at the daily rate so far."""
    left = F.greatest(F.lit(0), F.dayofmonth(F.last_day(day)) - F.dayofmonth(day))
    return spent + spent / F.dayofmonth(day) * left
