"""From bucket memberships to bounded blocks in which all pairs of a bucket are verified, without a row for any pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.joins import looked_up

#: Members of a block; two blocks meet in one unit of work.
BLOCK = 256
UNIT = ("band", "key", "i", "j")


def shared_buckets(memberships: DataFrame, total: int) -> DataFrame:
    """(band, key, n, lead, node) of ``memberships`` (band, key, node) whose bucket has several nodes.

    No row may repeat, and there are ``total`` of them at most. Of buckets with the same nodes only that of the least band
    stays. ``lead`` is the least hash of a bucket's nodes. Buckets of very many nodes are looked up apart from the others.
    """
    keyed = memberships.withColumn("bucket", F.unhex(F.concat(F.lpad(F.hex("band"), 16, "0"), F.lpad(F.hex("key"), 16, "0"))))
    h = F.xxhash64("node")
    sums = [F.count("*").alias("n"), F.min(h).alias("lead"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")]
    several = keyed.groupBy("bucket").agg(*sums).filter("n > 1")
    kept = several.groupBy("n", "lead", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "lead")
    found = looked_up(keyed, kept, on="bucket", count="n", total=total, values=["n", "lead"], spread="node")
    return found.filter("n is not null").select("band", "key", "n", "lead", "node")


def _n_blocks(n: str) -> Column:
    return F.ceil(F.col(n) / BLOCK).cast("int")


def blocks(shared: DataFrame) -> DataFrame:
    """(band, key, i, j, side, node): a bucket of n nodes has ceil(n / BLOCK) blocks, and every two blocks i <= j meet once."""
    count = _n_blocks("n")
    side = F.pmod(F.xxhash64("node"), F.col("count")).cast("int")
    placed = shared.withColumn("count", count).withColumn("side", side)
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    return other.select("band", "key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node")


def stars(shared: DataFrame) -> DataFrame:
    """(band, key, i, j, node, lead, wide): each block of a bucket once, with the bucket's lead wherever it isn't a member.

    Nodes that are connected with the lead need no pairs among themselves, if only components are asked for. ``lead`` marks
    the lead and ``wide`` the buckets of several blocks.
    """
    h, count = F.xxhash64("node"), _n_blocks("n")
    placed = shared.withColumn("count", count).withColumn("side", F.pmod(h, F.col("count")).cast("int"))
    told = placed.select("band", "key", "side", "count", "node", (h == F.col("lead")).alias("lead"), (F.col("count") > 1).alias("wide"))
    members = told.select("band", "key", F.col("side").alias("i"), F.lit(-1).alias("j"), "node", "lead", "wide")
    others = told.filter("lead and wide").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("count") - 1))).filter("i <> side")
    return members.union(others.select("band", "key", "i", F.lit(-1).alias("j"), "node", "lead", "wide"))


def loose_blocks(shared: DataFrame, loose: DataFrame, total: int) -> DataFrame:
    """(band, key, i, j, node): every block j of ``loose`` (band, key, node) with every block i of the whole bucket."""
    bucket = F.unhex(F.concat(F.lpad(F.hex("band"), 16, "0"), F.lpad(F.hex("key"), 16, "0")))
    h, whole, parts = F.xxhash64("node"), _n_blocks("n"), _n_blocks("m")
    marked = loose.select("band", "key", "node", F.lit(True).alias("loose"))
    sizes = loose.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("m"))
    of_bucket = shared.withColumn("bucket", bucket).groupBy("bucket").agg(F.first("n").alias("n")).join(sizes, "bucket")
    rows = shared.select("band", "key", "node", F.lit(False).alias("loose")).union(marked).withColumn("bucket", bucket)
    found = looked_up(rows, of_bucket, on="bucket", count="n", total=total, values=["n", "m"], spread="node").filter("n is not null")
    members = found.filter("not loose").select("band", "key", F.pmod(h, whole).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("j"), "node")
    apart = found.filter("loose").select("band", "key", F.explode(F.sequence(F.lit(0), whole - 1)).alias("i"), F.pmod(h, parts).cast("int").alias("j"), "node")
    return members.union(apart)


def by_unit(verify: Callable[[pd.DataFrame], pd.DataFrame | None]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over rows sorted by UNIT: calls ``verify`` on each unit's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            ids = pdf[list(UNIT)].to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist(), len(pdf)]
            out = [verify(pdf.iloc[s:e]) for s, e in zip(edges[:-2], edges[1:-1], strict=True)]
            if out := [x for x in out if x is not None and len(x)]:
                yield pd.concat(out, ignore_index=True)
            held = pdf.iloc[edges[-2] :]
        if held is not None and len(held) and (last := verify(held)) is not None:
            yield last

    return run


def in_units(rows: DataFrame) -> DataFrame:
    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT)


def linked_groups(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the first row it is connected with."""
    label = np.arange(len(linked))
    a, b = np.nonzero(linked)
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
