"""tallyhouse — a sales warehouse built as Spark DataFrame / SQL plans.

Operational tables are snapshotted into immutable Parquet runs, rebuilt into a
customer / product / date star schema with stable keys and exact decimal
revenue, gated by quality checks, published behind a pointer, and queried by
the reporting operators in :mod:`tallyhouse.operators`.
"""

__all__ = ["__version__"]

__version__ = "0.1.0"
