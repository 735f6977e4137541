"""Ids out of addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of a video and of a channel address, fixed patterns, in the order in which they are tried.
VIDEO_FORMS = (r"youtube\.com/watch\?.*?v=([A-Za-z0-9_-]{11})", r"youtu\.be/([A-Za-z0-9_-]{11})", r"youtube\.com/shorts/([A-Za-z0-9_-]{11})")
CHANNEL, HANDLE = r"youtube\.com/channel/(UC[A-Za-z0-9_-]{22})", r"youtube\.com/(@[A-Za-z0-9_.-]+)"
VIDEO_ID = r"^[A-Za-z0-9_-]{11}$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_match(x, *patterns: str) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(_c(x), p, 1), F.lit("")) for p in patterns])


def video_id(x) -> Column:
    """The 11-character id in a watch, short or share address, or in the query of another address of these hosts or of none; else null."""
    host = F.lower(F.try_parse_url(_c(x), F.lit("HOST")))
    value = query_value(x, "v")
    ours = host.isNull() | host.endswith("youtube.com") | (host == "youtu.be")
    return F.coalesce(first_match(x, *VIDEO_FORMS), F.when(ours & value.rlike(VIDEO_ID), value))


def channel_id(x) -> Column:
    """A channel id, or a handle with its sign, in an address of the host; else null."""
    return first_match(x, CHANNEL, HANDLE)


def naive_id(x) -> Column:
    """What stands between the last `v=` and the next `&`."""
    return F.element_at(F.split(F.element_at(F.split(_c(x), "v=", -1), -1), "&", -1), 1)


def query_value(x, key: str) -> Column:
    return F.try_parse_url(_c(x), F.lit("QUERY"), F.lit(key))
