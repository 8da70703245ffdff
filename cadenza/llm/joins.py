"""Joins that hold where a single key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one in this many of all rows is sent to all tasks; there are fewer such keys than this.
SHARES = 4096


def digest(*columns: Column | str) -> Column:
    """Sixteen bytes of hash; the second half starts from another seed, so both halves count."""
    halves = [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]
    return F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))


def looked_up(rows: DataFrame, table: DataFrame, *, on: str, count: str, total: int, values: list[str], spread: str) -> DataFrame:
    """``rows`` with the columns ``values`` of ``table`` (``on``, ``count``, ``values``), null where it lacks the key.

    ``on`` is a digest of sixteen bytes or a number, null at most in ``rows``; ``table`` has each key once, with a first value that isn't
    null and in ``count`` how many of the ``total`` rows have the key at most. Keys of more than total / SHARES rows are
    fewer than SHARES and broadcast, so their rows need no exchange by key; they, and rows without a key, go by ``spread``.
    """
    frequent = F.col(count) * SHARES > total
    hot = table.filter(frequent).select(F.col(on).alias("_hot"), *[F.col(v).alias(f"_hot_{v}") for v in values])
    binary = dict(table.dtypes)[on] == "binary"
    exact = F.col(on) if binary else F.concat(F.lit("n"), F.col(on).cast("string")).cast("binary")
    cold = table.filter(~frequent).select(exact.alias("_cold"), *[F.col(v).alias(f"_cold_{v}") for v in values])
    seen = rows.join(F.broadcast(hot), F.col(on) == F.col("_hot"), "left")  # under SHARES rows
    apart = F.concat(F.lit("apart "), F.lpad(F.hex(F.xxhash64(spread)), 16, "0")).cast("binary")  # too long or short for a digest, no number
    keyed = seen.withColumn("_key", F.when(F.col("_hot").isNull() & F.col(on).isNotNull(), exact).otherwise(apart))
    both = keyed.join(cold, F.col("_key") == F.col("_cold"), "left")
    return both.select(*rows.columns, *[F.coalesce(f"_hot_{v}", f"_cold_{v}").alias(v) for v in values])
