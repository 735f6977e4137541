"""Short forms of JSON payloads."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST_KEYS = 10


def summary_of(text: str | None) -> str | None:
    """Scalars as they are, lists as `<key>_count`, objects as `<key>_keys`, for the first keys of an object."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return None
    if not isinstance(value, dict):
        return json.dumps({"count": len(value)} if isinstance(value, list) else {"value": value})
    out = {}
    for k, v in list(value.items())[:FIRST_KEYS]:
        if isinstance(v, list):
            out[f"{k}_count"] = len(v)
        elif isinstance(v, dict):
            out[f"{k}_keys"] = sorted(v)
        else:
            out[k] = v
    return json.dumps(out, sort_keys=True)


@F.pandas_udf(T.StringType())
def summarise(s: pd.Series) -> pd.Series:
    return s.map(summary_of)
