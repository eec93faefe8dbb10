"""Keys of many kinds in one aggregation: how often each is held and used.

A reference holds when its key is held, a unique key when it is held once. Every
table gives one row per key column of interest, (kind, key, second) with counts,
and one ``groupBy`` sums them: a table is read once for all of its keys, and a
hot key is one row per map task before the shuffle. Keys are compared as text.
A null key is a group of its own that refers to nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("used", "held", "marked", "unknown")


Key = Column | tuple[Column, Column]


def entries(df: DataFrame, held: dict[str, Key] | None = None, used: dict[str, Key] | None = None,
            n: Column | None = None, unless: Column | None = None, **marks: Column) -> DataFrame:
    """One row for each key of each row of ``df``: it counts as ``held`` or as
    ``used``, ``n`` times (once); ``marks`` are further counts, zero where not given.
    Where ``unless`` holds, only the held keys give rows."""
    n = F.lit(1) if n is None else n

    def row(kind: str, key: Key, side: str) -> Column:
        key, second = key if isinstance(key, tuple) else (key, F.lit(None))
        counts = marks | {side: n}
        return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), second.cast("string").alias("second"),
                        *[counts.get(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])

    own, refs = [[row(kind, key, side) for kind, key in (keys or {}).items()] for side, keys in (("held", held), ("used", used))]
    rows = F.array(*own, *refs)
    return df.select(F.inline(rows if unless is None else F.when(unless, F.array(*own)).otherwise(rows)))


def ledger(*frames: DataFrame, dealt: bool = False, tasks: int | None = None) -> DataFrame:
    """The counts of every key. ``dealt``: keys go to their task (of ``tasks``) before
    any are added up, for frames whose keys hardly repeat: a map task would hold a
    row for each of them, and spill, without making the shuffle smaller."""
    rows = reduce(DataFrame.unionByName, frames)
    if dealt:
        key = ("kind", "key", "second")
        rows = rows.repartition(tasks, *key) if tasks else rows.repartition(*key)
    return rows.groupBy("kind", "key", "second").agg(*[F.sum(c).alias(c) for c in COUNTS])


def total(value: Column, kind: str, where: Column | None = None) -> Column:
    """Sum of ``value`` over the keys of ``kind``; an aggregate over a ledger."""
    of = F.col("kind") == kind
    return F.coalesce(F.sum(F.when(of if where is None else of & where, value)), F.lit(0))


def dangling() -> Column:
    """Whether the key is held nowhere."""
    return F.col("key").isNull() | (F.col("held") == 0)


def repeated(kind: str) -> Column:
    """Number of held keys that occur more than once."""
    return total(F.lit(1), kind, F.col("held") > 1)


def surplus(kind: str) -> Column:
    """Held rows beyond the first of each key."""
    return total(F.col("held") - 1, kind, F.col("held") > 1)
