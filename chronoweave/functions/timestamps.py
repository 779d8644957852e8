"""Lenient reading and fixed rendering of times; the session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DATE, CLOCK = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}(?:\.\d+)?"
AWARE = rf"^{DATE}[Tt ]{CLOCK}(?:Z|[+-]\d{{2}}:\d{{2}})$"
NAIVE = rf"^{DATE}(?:[T ](?:{CLOCK}|\d{{2}}:\d{{2}}))?$"


def parse_time(raw: Column) -> Column:
    """A time with or without zone (then UTC), without seconds, or a date alone; anything else is null."""
    fits = raw.rlike(AWARE) | raw.rlike(NAIVE)
    return F.when(fits, F.upper(raw).try_cast("timestamp"))


def iso_seconds(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def iso_millis(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
