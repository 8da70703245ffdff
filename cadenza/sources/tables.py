"""Intermediate tables that later steps read several times."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Measures(dict):
    """What stages told of themselves as they ran, by stage: the count of rows, and least and greatest values of their columns."""


#: Rows of a partition that are sorted or gathered at once, on average.
ROWS = 500_000


def sized(spark: SparkSession, rows: int) -> int:
    """The number of partitions for ``rows`` rows: the session's number of shuffle partitions, raised if ROWS a partition need more.

    The raised number is set for the session, as the shuffles of joins and aggregates further on are as large; adaptive
    execution joins their partitions again where they are small. So what one task sorts doesn't grow with the input.
    """
    known = int(spark.conf.get("spark.sql.shuffle.partitions"))
    needed = max(known, math.ceil(rows / ROWS))
    if needed > known:
        spark.conf.set("spark.sql.shuffle.partitions", str(needed))
    return needed


@contextmanager
def _fixed(spark: SparkSession, fixed: bool) -> Iterator[None]:
    """Plans made meanwhile are not adaptive if ``fixed``."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    if fixed:
        spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _shared(spark: SparkSession) -> str:
    """The folder of checkpoints: spark.checkpoint.dir; where none is set, a session on one machine (as in tests) gets a temporary one and any other an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, read again: it needs a fraction of a checkpoint's disk, and later plans read only the columns they use."""
    path = f"{_shared(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, *by: str, stage: str | None = None, measures: Measures | None = None, of: tuple[str, ...] = (), fixed: bool = False) -> DataFrame:
    """``df`` written to the shared checkpoint folder, dealt out by its first column of ``by`` and sorted by all of them.

    Later plans start from the table instead of repeating what made it. With ``fixed`` they keep its partitioning and order too, so
    windows, joins and aggregates by that column need no further shuffle. An adaptive plan tells neither of its result, and
    joins the partitions of each shuffle by their compressed bytes, so what a task then sorts grows with the table. The folder is spark.checkpoint.dir; where none is set, a session on
    one machine (as in tests) gets a temporary one and any other an error. With ``measures`` the rows are counted, and the least
    and greatest of the columns or expressions ``of`` found, while they are written, and told under ``stage``; there is no further pass.
    """
    _shared(df.sparkSession)
    if by:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(partitions, by[0]).sortWithinPartitions(*by)
    with _fixed(df.sparkSession, fixed):
        if measures is None or stage is None:
            return df.checkpoint()
        told = Observation(stage)
        ends = [f(F.expr(c)).alias(f"{name}_{c}") for c in of for name, f in (("least", F.min), ("greatest", F.max))]
        out = df.observe(told, F.count(F.lit(1)).alias("rows"), *ends).checkpoint()
        measures[stage] = told.get
        return out
