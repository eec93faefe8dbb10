"""Declared schemas of the raw (lake) layer and the star layer.

Nothing is inferred: sources are cast to these types and a value that does not
fit raises (ANSI mode), which fails the run.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
REVENUE = T.DecimalType(14, 2)


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


RAW = {
    "customers": _s(("id", T.StringType()), ("name", T.StringType()), ("email", T.StringType()),
                    ("city", T.StringType()), ("state", T.StringType()),
                    ("created_at", T.TimestampNTZType())),
    "products": _s(("id", T.StringType()), ("sku", T.StringType()), ("name", T.StringType()),
                   ("category", T.StringType()), ("unit_price", MONEY),
                   ("active", T.BooleanType()), ("created_at", T.TimestampNTZType())),
    "orders": _s(("id", T.StringType()), ("customer_id", T.StringType()),
                 ("status", T.StringType()), ("order_date", T.DateType()),
                 ("created_at", T.TimestampNTZType())),
    "order_items": _s(("id", T.StringType()), ("order_id", T.StringType()),
                      ("product_id", T.StringType()), ("quantity", T.IntegerType()),
                      ("unit_price_at_sale", MONEY)),
}

STAR = {
    "dim_customer": _s(("customer_key", T.LongType()), ("customer_id", T.StringType()),
                       ("name", T.StringType()), ("city", T.StringType()),
                       ("state", T.StringType()), ("created_at", T.TimestampNTZType())),
    "dim_product": _s(("product_key", T.LongType()), ("product_id", T.StringType()),
                      ("sku", T.StringType()), ("name", T.StringType()),
                      ("category", T.StringType()), ("current_unit_price", MONEY),
                      ("active", T.BooleanType())),
    "dim_date": _s(("date_key", T.IntegerType()), ("full_date", T.DateType()),
                   ("day", T.IntegerType()), ("month", T.IntegerType()),
                   ("month_name", T.StringType()), ("quarter", T.IntegerType()),
                   ("year", T.IntegerType()), ("is_weekend", T.BooleanType())),
    "fact_sales": _s(("sale_key", T.LongType()), ("order_id", T.StringType()),
                     ("order_item_id", T.StringType()), ("customer_key", T.LongType()),
                     ("product_key", T.LongType()), ("date_key", T.IntegerType()),
                     ("quantity", T.IntegerType()), ("unit_price", MONEY),
                     ("revenue", REVENUE)),
    "warehouse_metadata": _s(("key", T.StringType()), ("value", T.StringType())),
}


def conform(df, schema: T.StructType):
    """Select ``schema``'s columns in order, cast to the declared types."""
    from pyspark.sql import functions as F
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
