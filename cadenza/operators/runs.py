"""Runs of seconds: gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.align import until


def islands(seconds: DataFrame, gap: int = 0) -> DataFrame:
    """``seconds`` (or stretches of them) with the number of their run in the recording, ``island``."""
    by_time = Window.partitionBy("video_id").orderBy("t")
    new = F.coalesce((F.col("t") - F.lag(until(seconds)).over(by_time) > gap).cast("int"), F.lit(0))
    return seconds.withColumn("new", new).withColumn("island", F.sum("new").over(by_time)).drop("new")


def runs(grid: DataFrame, holds: Column, least: int, gap: int = 0) -> DataFrame:
    """(video_id, start_sec, end_sec) of the half-open runs where ``holds``, at least ``least`` seconds long.

    Runs that at most ``gap`` seconds part are one; seconds before the first and after the last are never filled in. Only
    seconds that hold are shuffled and sorted.
    """
    found = islands(grid.filter(holds).select("video_id", "t", until(grid).alias("until")), gap).groupBy("video_id", "island").agg(F.min("t").alias("start_sec"), F.max("until").alias("end_sec"))
    return found.filter(F.col("end_sec") - F.col("start_sec") >= least).select("video_id", "start_sec", "end_sec")
