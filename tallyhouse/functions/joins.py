"""One-row joins without a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(df: DataFrame) -> Column:
    """The single row of ``df`` (a global aggregate) as a struct scalar subquery.

    This replaces a cross join with a one-row frame. The planner runs the
    subquery once and uses its value as a constant, and a second row raises at
    run time, so the bound is enforced rather than assumed. Read fields as
    ``one_row(df)["name"]``.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).scalar()
