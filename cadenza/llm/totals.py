"""Sums of equally long arrays that tasks gather, cut into slices so that no task holds more than one whole sum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 1 << 14
#: Tasks whose slices are added first, before the sums of all such groups are.
NEIGHBOURS = 32


def slices(total: np.ndarray) -> pd.DataFrame:
    """What a task yields of an array of float64 that it has gathered: its slices that aren't all zero."""
    found = [(k, total[k : k + SLICE].tobytes()) for k in range(0, len(total), SLICE) if total[k : k + SLICE].any()]
    return pd.DataFrame(found, columns=["slice", "sums"])


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' arrays of ``size`` numbers; ``parts`` has the rows of ``slices``.

    Slices of one place and of neighbouring tasks meet first, then their sums; they are added as they come, so a task
    holds at most ``size`` numbers, and the driver gets as many, however many tasks there were.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, raw in zip(pdf["slice"].tolist(), pdf["sums"], strict=True):
                part = np.frombuffer(raw)
                total[k] = total[k] + part if k in total else part
        yield pd.DataFrame({"slice": list(total), "sums": [x.tobytes() for x in total.values()]})

    out = np.zeros(size)
    near = F.floor(F.spark_partition_id() / NEIGHBOURS)
    first = parts.withColumn("near", near).repartition("slice", "near").select("slice", "sums").mapInPandas(add, "slice long, sums binary")
    for row in first.repartition("slice").mapInPandas(add, "slice long, sums binary").collect():
        part = np.frombuffer(row["sums"])
        out[row["slice"] : row["slice"] + len(part)] = part
    return out
