"""Joins that hold where a single key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in this many of all rows is joined by broadcast; there are fewer such keys than this.
SHARES = 4096


def matched(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has each key ``on`` once and in ``count`` how many of the ``total`` rows have it.

    Keys of more than total / SHARES rows are fewer than SHARES, so their part of ``table`` is broadcast and their rows stay
    where they are; all other rows are exchanged by key.
    """
    frequent = F.col(count) * SHARES > total
    hot, cold = table.filter(frequent), table.filter(~frequent)
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return rows.join(F.broadcast(hot), on).unionByName(others)
