"""Joins to a table of keys of which some stand on very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy from 1 / HEAVY_SHARE of all rows on, so there are at most so many heavy keys.
HEAVY_SHARE = 10_000


def joined(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row per ``key``, ``weight`` of the ``total`` rows stand on it; both columns must be its own).

    Rows on heavy keys meet a broadcast of at most HEAVY_SHARE rows and are not
    shuffled; all others meet by shuffle. Both inputs are read twice: give
    written tables. Null keys meet nothing.
    """
    heavy = table.where(F.col(weight) * HEAVY_SHARE > total).drop(weight)
    light = table.where(F.col(weight) * HEAVY_SHARE <= total).drop(weight)
    on_heavy = rows.join(F.broadcast(heavy), key)
    on_light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return on_heavy.unionByName(on_light)
