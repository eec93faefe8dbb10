"""Column-level helpers: money, dates, text, keys and join sizing."""
