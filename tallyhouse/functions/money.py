"""Money arithmetic: decimal inside, double only at the result edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column) -> Column:
    """Money value at the edge: null → 0, decimal → double (exact 2 dp)."""
    return F.coalesce(c, F.lit(0)).cast("double")


def count_out(c: Column) -> Column:
    """Count / units at the edge: null → 0, bigint."""
    return F.coalesce(c, F.lit(0)).cast("long")


def cents(c: Column) -> Column:
    """Money decimal → integral cents as decimal(38,0) (exact)."""
    return (c * 100).cast("decimal(38,0)")


def round_div_cents(num_cents: Column, den: Column) -> Column:
    """round(num_cents / den) half away from zero, exact (integer arithmetic).

    Dividing two decimals in Spark first rounds to at least 6 places, which can
    double-round; integral division plus a remainder test cannot.
    """
    n = num_cents.cast("decimal(38,0)")
    d = den.cast("decimal(38,0)")
    quotient = F.floor(F.abs(n) / d)
    # floor of a rounded quotient can be off by one near an integer; fix with the remainder
    quotient = (F.when(quotient * d > F.abs(n), quotient - 1)
                .when((quotient + 1) * d <= F.abs(n), quotient + 1)
                .otherwise(quotient))
    remainder = F.abs(n) - quotient * d
    rounded = F.when(remainder * 2 >= d, quotient + 1).otherwise(quotient)
    return F.when(n < 0, -rounded).otherwise(rounded).cast("decimal(38,0)")


def avg_money(total: Column, count: Column) -> Column:
    """round(total / count, 2) as double, 0 when count is 0 (total is decimal money)."""
    return (F.when(count > 0, round_div_cents(cents(total), count).cast("double") / 100)
            .otherwise(F.lit(0.0)))
