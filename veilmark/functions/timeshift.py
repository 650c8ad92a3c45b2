"""Time stamps inside text, moved by a number of seconds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FLAGS, replace_matches

# The time stamps that are moved.
ISO = r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"
LOGCAT = r"\b\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}\b"
EPOCH_MS = r"\b1[6-9]\d{11}\b"
EPOCH_S = r"\b1[6-9]\d{8}\b"


def _clock(clock: Column, seconds: int) -> Column:
    """hh:mm:ss moved within its day."""
    part = lambda i: F.substring(clock, i, 2).cast("int")
    total = F.pmod(part(1) * 3600 + part(4) * 60 + part(7) + seconds, F.lit(86_400))
    return F.concat_ws(":", *(F.lpad(x.cast("string"), 2, "0") for x in (F.floor(total / 3600), F.floor(total / 60) % 60, total % 60)))


def shift_iso(m: Column, seconds: int, keep_date: bool) -> Column:
    wrapped = F.concat(F.substring(m, 1, 11), _clock(F.substring(m, 12, 8), seconds), F.substring(m, 20, 64))
    if keep_date:
        return wrapped
    moved = F.try_to_timestamp(F.concat(F.substring(m, 1, 10), F.lit(" "), F.substring(m, 12, 8)), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz") + F.expr(f"make_dt_interval(0, 0, 0, {seconds})")
    text = F.date_format(moved, "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(F.concat(F.substring(text, 1, 10), F.substring(m, 11, 1), F.substring(text, 12, 8), F.substring(m, 20, 64)), wrapped)


def shift_text(text: Column, seconds: int, mode: str = "date") -> Column:
    """mode 'date' carries into the date and moves each stamp once; 'wrap' keeps the date, turns the
    clock within the day and moves stamps that match two patterns twice."""
    if mode not in ("date", "wrap"):
        raise ValueError("mode is date or wrap")
    wrap = mode == "wrap"
    logcat = lambda m: F.concat(F.substring(m, 1, 6), _clock(F.substring(m, 7, 8), seconds), F.substring(m, 15, 4))
    out = replace_matches(text, FLAGS + ISO, lambda m: shift_iso(m, seconds, wrap))
    out = replace_matches(out, FLAGS + (LOGCAT if wrap else r"(?<!\d-)" + LOGCAT), logcat)
    out = replace_matches(out, FLAGS + EPOCH_MS, lambda m: (m.cast("bigint") + seconds * 1000).cast("string"))
    return replace_matches(out, FLAGS + EPOCH_S, lambda m: (m.cast("bigint") + seconds).cast("string"))


def parse_duration(text: str) -> int:
    """Seconds of 90, 90s, 15m, 2h."""
    m = re.fullmatch(r"\s*(\d+)\s*([hms]?)\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text}")
    return int(m[1]) * {"h": 3600, "m": 60}.get(m[2], 1)
