"""All registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from . import aggregates, alignment, changes, extracts, filters, joins, scalars, sequences, sources, windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "agg_pivot_counts"


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict:
    return ORACLE_SQL
