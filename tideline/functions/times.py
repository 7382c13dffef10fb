"""Time as whole microseconds. Event times carry no zone (TIMESTAMP_NTZ)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def micros(width: str | int) -> int:
    """Length of a duration such as ``'24 hours'`` in microseconds."""
    if isinstance(width, int):
        return width
    return pd.Timedelta(width) // pd.Timedelta(microseconds=1)


def micros_of(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp column. Needs the session time zone
    UTC; ``timestampdiff`` would not, but takes twice as long."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def from_micros(us: Column) -> Column:
    """Inverse of :func:`micros_of`. Needs the session time zone UTC."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def bucket_start(us: Column, width: int) -> Column:
    """Start of the fixed-width bucket holding ``us``; exact for times before 1970 too."""
    return us - F.pmod(us, F.lit(width))
