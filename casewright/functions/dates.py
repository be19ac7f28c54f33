"""Timestamp parsing and day rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tried in order; month comes first in slashed dates.
DEFAULT_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy",
    "yyyyMMdd",
)


def parse_ts(c: Column, formats: Sequence[str] = DEFAULT_FORMATS, strict: bool = False) -> Column:
    """First format that fits. Bad text gives null, or fails the job when ``strict``."""
    parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats])
    if not strict:
        return parsed
    failure = F.raise_error(F.concat(F.lit("not a timestamp: "), c)).cast("timestamp_ntz")
    return F.when(c.isNotNull(), F.coalesce(parsed, failure))


def day_str(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
