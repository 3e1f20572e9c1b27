"""Cue times: text to milliseconds and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIME = r"^(?:([0-9]+):)?([0-9]{1,2}):([0-9]{2})(?:[.,]([0-9]{1,3}))?$"


def parse_time(text: Column) -> Column:
    """`[h:]m:ss[.f]` in milliseconds; anything else is an error."""
    part = lambda i: F.regexp_extract(text, _TIME, i)
    hours = F.coalesce(F.nullif(part(1), F.lit("")), F.lit("0")).cast("long")
    value = ((hours * 60 + part(2).cast("long")) * 60 + part(3).cast("long")) * 1000 + F.rpad(part(4), 3, "0").cast("long")
    return F.when(text.rlike(_TIME), value).otherwise(F.raise_error(F.concat(F.lit("Invalid subtitle time: "), F.coalesce(text, F.lit("null")))).cast("long"))


def timestamp(ms: Column, mark: str = ",") -> Column:
    """HH:MM:SS and milliseconds after mark; hours have no upper bound, negative times are 0."""
    n = F.greatest(F.lit(0), ms.cast("long"))
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(n / 3_600_000), F.floor(n / 60_000) % 60, F.floor(n / 1000) % 60, n % 1000)


def ass_timestamp(ms: Column) -> Column:
    """H:MM:SS.cc, rounded half up to hundredths."""
    n = F.greatest(F.lit(0), F.floor(ms / 10 + 0.5).cast("long"))
    return F.format_string("%d:%02d:%02d.%02d", F.floor(n / 360_000), F.floor(n / 6000) % 60, F.floor(n / 100) % 60, n % 100)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
