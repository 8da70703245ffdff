"""Joins of spans of time within recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def meeting(left: DataFrame, left_span: tuple[str, str], right: DataFrame, right_span: tuple[str, str], width: int = 60) -> DataFrame:
    """Pairs of rows of one recording whose spans share a stretch of ``width`` seconds, so all that meet and some that don't.

    Both sides are dealt out by recording and stretch, and a pair is made once, in the first stretch that both touch: a
    long recording is neither one task nor a product of all its rows. The sides' columns but video_id have different names.
    """

    def dealt(df: DataFrame, span: tuple[str, str], first: str) -> DataFrame:
        start, end = (F.floor(F.col(c) / width) for c in span)
        return df.withColumn(first, start).withColumn("stretch", F.explode(F.sequence(first, F.greatest(first, end))))

    pairs = dealt(left, left_span, "_left").join(dealt(right, right_span, "_right"), ["video_id", "stretch"])
    return pairs.filter(F.col("stretch") == F.greatest("_left", "_right")).drop("stretch", "_left", "_right")
