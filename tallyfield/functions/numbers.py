"""Numbers, ids and dates from text, null or a default where it can't be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bare(x) -> Column:
    """Without thousands separators and currency signs; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(_c(x), r"[,$]", "")), F.lit(""))


def parse_int(x, default: int | None = 0) -> Column:
    """A whole number; anything else, like 12.5, is the default; blanks are null."""
    n = bare(x).try_cast("bigint")
    whole = F.when(bare(x).rlike(r"^[+-]?\d+$"), n)
    return F.when(bare(x).isNull(), F.lit(None)).otherwise(F.coalesce(whole, F.lit(default)))


def parse_float(x, default: float | None = 0.0) -> Column:
    return F.when(bare(x).isNull(), F.lit(None)).otherwise(F.coalesce(bare(x).try_cast("double"), F.lit(default)))


def safe_float(x) -> Column:
    """Null for blanks and what is no number."""
    return F.nullif(F.trim(_c(x)), F.lit("")).try_cast("double")


def hash_id(*parts) -> Column:
    """31 bits of the MD5 of the lower-cased parts joined by a bar."""
    key = F.concat_ws("|", *[F.lower(_c(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(2147483647))


def unit_value(value, unit, expected: str) -> Column:
    """The rounded value if its unit is the expected one, else null."""
    return F.when(_c(unit) == expected, F.round(safe_float(value)).cast("bigint"))


def parse_rfc3339(x) -> Column:
    return F.try_to_timestamp(F.regexp_replace(_c(x), "Z$", "+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def round_gap(now, back) -> Column:
    return F.greatest(F.lit(0), _c(back) - _c(now))
