"""The result edge: how a DataFrame leaves the warehouse.

The reference serves JSON: money as numbers, calendar dates as ``yyyy-MM-dd``
text, instants as text. ``to_edge`` applies that to any frame — decimals to
double, dates and timestamps to ISO text (wall-clock times as written,
instants in UTC) — so results compare exactly with the SQL oracle whatever the
session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_DAY_MICROS = 86_400_000_000


def instant_text(c: Column) -> Column:
    """An instant (TIMESTAMP) as ``yyyy-MM-dd HH:mm:ss`` in UTC, whatever the
    session time zone: calendar day and time of day come from the epoch
    microseconds, so no zone rule (or daylight-saving gap) is involved."""
    micros = F.unix_micros(c)
    day = F.floor(micros / _DAY_MICROS)
    secs = F.floor((micros - day * _DAY_MICROS) / 1_000_000).cast("long")
    return F.when(c.isNotNull(), F.format_string(
        "%s %02d:%02d:%02d", F.date_from_unix_date(day.cast("int")).cast("string"),
        (secs / 3600).cast("long"), ((secs % 3600) / 60).cast("long"), secs % 60))


def wall_clock_text(c: Column) -> Column:
    """A wall-clock time (TIMESTAMP_NTZ) as ``yyyy-MM-dd HH:mm:ss``, from its
    own text: no session time zone is involved."""
    return F.substring(c.cast("string"), 1, 19)


def to_edge(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = wall_clock_text(c)
        elif isinstance(f.dataType, T.TimestampType):
            c = instant_text(c)
        cols.append(c.alias(f.name))
    return df.select(cols)
