"""Joins that a hot key can't send to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task may get whatever the input, and the most keys that may be broadcast as hot.
LEAST, MOST = 1000, 10_000
#: Rows (of some 40 bytes) of a table that may be broadcast.
BROADCAST = 200_000


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, n: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (unique by ``keys``), without ``weight``, the number of rows that have the key.

    Keys of more than max(LEAST, n / MOST) rows are joined by broadcast; as their rows are among the ``n``, there
    are MOST of them at the most. The other keys are shuffled. ``rows`` are read twice: give a written table.
    """
    limit = max(LEAST, n // MOST)
    heavy = F.broadcast(table.where(F.col(weight) > limit))
    light = table.where(F.col(weight) <= limit).drop(weight)
    hot = rows.join(heavy, keys).drop(weight)
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys, how)
    return hot.unionByName(rest)


def look_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (unique by ``key``): by broadcast where it is small, else with hot keys split off. Give written tables."""
    if table.count() <= BROADCAST:
        return rows.join(F.broadcast(table), key, how)
    sizes = rows.groupBy(key).agg(F.count("*").alias("size_"))
    return join_hot(rows, table.join(sizes, key), [key], "size_", rows.count(), how)
