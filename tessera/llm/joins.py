"""Joins that no hot key makes uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys up to which their whole table is broadcast, and beyond it the share of all rows from which a key is hot: at most ``HOT`` keys are.
BROADCAST_KEYS, HOT, LEAST_HOT = 500_000, 10_000, 64


def joined_with_hot(rows: DataFrame, side: DataFrame, key: str, total: int, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``rows`` left joined with ``side(key, n, ...)``, whose keys are distinct; n is how many of the ``total`` rows have the key.

    A side of many keys is joined by a shuffle, but its hot keys by a
    broadcast.  Null keys match nothing.
    """
    if side.count() <= broadcast_keys:
        return rows.join(F.broadcast(side), key, "left")
    most = max(LEAST_HOT, total // HOT)
    hot = F.broadcast(side.where(F.col("n") > most))
    cold = rows.join(hot.select(key), key, "left_anti").join(side.where(F.col("n") <= most), key, "left")
    return rows.join(hot, key).unionByName(cold)
