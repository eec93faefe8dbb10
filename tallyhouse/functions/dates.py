"""Calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_key(d: Column) -> Column:
    """yyyymmdd as int."""
    return F.date_format(d, "yyyyMMdd").cast("int")


def date_attributes(d: Column) -> list[Column]:
    """The dim_date columns for a DateType column ``d``."""
    return [
        date_key(d).alias("date_key"),
        d.alias("full_date"),
        F.dayofmonth(d).alias("day"),
        F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).alias("quarter"),
        F.year(d).alias("year"),
        (F.weekday(d) >= 5).alias("is_weekend"),
    ]


def iso_text(d: Column) -> Column:
    """A calendar date as ``yyyy-MM-dd`` text (no zone shift on DateType)."""
    return F.date_format(d, "yyyy-MM-dd")


def week_start(d: Column) -> Column:
    """Monday of the ISO week that owns ``d``."""
    return F.date_trunc("week", d).cast("date")


def month_start(d: Column) -> Column:
    return F.date_trunc("month", d).cast("date")
