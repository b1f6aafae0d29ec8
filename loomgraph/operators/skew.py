"""Joins with a table of one row per key, where a few keys may hold most of the other side's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than this share of all rows; so fewer than 1 / SHARE keys are.
SHARE = 1 / 2000
#: So many rows of one key don't burden a task, whatever their share.
LIGHT = 100_000


def heavy_join(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``keyed``, which has one row per key and in ``weight`` at least as many as the key has in ``rows``; total: the sum of weights.

    The rows of heavy keys stay where they are and meet a broadcast table, of fewer than
    1 / SHARE rows by the definition of heavy; the others are shuffled, and no key of
    theirs fills a task.
    """
    if total <= LIGHT:  # no key can be heavy
        return rows.join(keyed.drop(weight), on, how)
    least = max(LIGHT, int(total * SHARE))
    heavy, light = keyed.where(F.col(weight) > least).drop(weight), keyed.where(F.col(weight) <= least).drop(weight)
    near = rows.join(F.broadcast(heavy), on)
    far = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on, how)
    return near.unionByName(far)
