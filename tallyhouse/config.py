"""Fixed values the warehouse semantics depend on.

Fixed values (must stay as written for results to match the specified behaviour):
"""

from __future__ import annotations

# --- fixed values ---------------------------------------------------------
SCHEMA_VERSION = "1.0.0"
PIPELINE_VERSION = "0.1.0"

# A cancelled order is not a sale: excluded from the date bounds, the facts and
# the completeness check.
EXCLUDED_ORDER_STATUSES = ("cancelled",)

ORDER_STATUSES = ("pending", "confirmed", "shipped", "delivered", "cancelled")
DEFAULT_ORDER_STATUS = "pending"
RUN_STATUSES = ("queued", "running", "succeeded", "failed")
ACTIVE_RUN_STATUSES = ("queued", "running")

RAW_TABLES = ("customers", "products", "orders", "order_items")
STAR_TABLES = ("dim_customer", "dim_product", "dim_date", "fact_sales")

# Paging / report limits.
TOP_N_DEFAULT = 10
TOP_N_MAX = 100
PAGE_LIMIT_DEFAULT = 50
PAGE_LIMIT_MAX = 200
SEARCH_LIMIT = 200
SPARKLINE_POINTS = 28
FLAT_DELTA_BAND = 0.0005

# Order intake limits.
MAX_LINES_PER_ORDER = 50
MAX_QUANTITY_PER_LINE = 1000

# Error summaries kept in the run audit.
MAX_SUMMARY_LENGTH = 500
REDACTED = "[redacted]"

# Patterns (Java regex syntax; also valid RE2 for the DuckDB oracle).
UUID_V4_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
# --- end of fixed values ----------------------------------------------------
