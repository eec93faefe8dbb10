"""Fixture F1 of the warehouse tests and a helper that makes its frames."""

import datetime as dt
from decimal import Decimal

D = Decimal
TS = dt.datetime(2026, 1, 1, 0, 0)

# Fixture F1: 2 customers, 2 products (one retired), 3 orders (one cancelled).
F1 = {
    "customers": [("c-pune", "Asha", "asha@example.com", "Pune", "Maharashtra", TS),
                  ("c-kochi", "Ravi", "ravi@example.com", "Kochi", "Kerala", TS)],
    "products": [("p-elec", "ELEC-0001", "Phone", "Electronics", D("1000.00"), True, TS),
                 ("p-groc", "GROC-0001", "Tea", "Grocery & Gourmet", D("250.50"), False, TS)],
    "orders": [("o-d", "c-pune", "delivered", dt.date(2026, 3, 1), TS),
               ("o-e", "c-kochi", "confirmed", dt.date(2026, 3, 4), TS),
               ("o-c", "c-pune", "cancelled", dt.date(2026, 3, 2), TS)],
    "order_items": [("i-1", "o-d", "p-elec", 2, D("1000.00")),
                    ("i-2", "o-d", "p-groc", 1, D("200.00")),
                    ("i-3", "o-e", "p-elec", 3, D("950.00")),
                    ("i-4", "o-c", "p-elec", 5, D("1000.00"))],
}


def raw_frames(spark, data):
    from tallyhouse.schemas import RAW
    return {t: spark.createDataFrame(rows, RAW[t]) for t, rows in data.items()}
