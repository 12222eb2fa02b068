"""Joins whose small side is checked before it is broadcast.

The checks count, so the small side should be a written or checkpointed table. Each helper falls back
to a plain join, for which Spark shuffles both sides and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IN_LIST_ROWS = 1_000  # goes into the scan as a filter
BROADCAST_ROWS = 200_000  # short rows: some 40 MB with long paths


def is_small(keys: DataFrame) -> bool:
    return keys.count() <= BROADCAST_ROWS


def if_small(keys: DataFrame) -> DataFrame:
    """The rows, marked for broadcast when there are few."""
    return F.broadcast(keys) if is_small(keys) else keys


def narrowed(rows: DataFrame, keys: DataFrame, on: str = "path") -> DataFrame:
    """Rows that have a key in `keys`, where leaving out the others is cheap; else all rows.

    For inputs of a join on the same key, which drops the others anyway. Very few keys are pushed
    into the scan, where they skip whole row groups of a sorted table.
    """
    keys = keys.select(on)
    few = keys.limit(BROADCAST_ROWS + 1).count()
    if few <= IN_LIST_ROWS:
        return rows.where(F.col(on).isin([r[0] for r in keys.collect()]))
    if few <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on, "left_semi")
    return rows
