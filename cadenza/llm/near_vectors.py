"""Near-duplicate vectors by Euclidean p-stable hashing (operator 2).

Vectors are scaled to length one, so a cosine bound is a distance bound. In each of several tables a vector's key is the
tuple of its random projections, shifted and cut to whole multiples of a width. All pairs of a bucket are verified by
their cosine in double precision, in blocks of bounded size that return counts and spanning links, no pairs. A pair that
meets in several tables counts in the first one alone. Equal vectors are one node throughout.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.candidates import blocks, by_unit, in_units, linked_groups, shared_buckets
from cadenza.llm.components import components
from cadenza.llm.joins import digest, looked_up
from cadenza.llm.lineage import bounded_batches, written

WIDTH = 2.0
#: Most pairs at the threshold itself that may meet in no table.
MISSED = 0.01
#: Unrelated vectors that share a vector's bucket, at most about this many.
STRAY = 0.1


def _meets(distance: float, width: float) -> float:
    """The probability that one projection puts two points of this distance into one cell."""
    x = width / distance
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Projections in a key and number of tables for ``n`` vectors: keys sharpen with log n, tables make up for it."""
    near, far = _meets(math.sqrt(2 - 2 * threshold), WIDTH), _meets(math.sqrt(2), WIDTH)
    k = max(4, math.ceil(math.log(max(n, 2) / STRAY) / -math.log(far)))
    return k, math.ceil(math.log(MISSED) / math.log1p(-(near**k)))


@functools.lru_cache(8)
def _projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([7, dim])
    return rng.standard_normal((dim, k * tables)), rng.uniform(0, WIDTH, k * tables), rng.integers(1, 1 << 63, k * tables, np.int64).astype(np.uint64) | np.uint64(1)


def keys(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """The key of each row of ``x`` (unit vectors) in each table."""
    a, b, odd = _projections(x.shape[1], k, tables)
    cell = np.floor((x @ a + b) / WIDTH).astype(np.int64).astype(np.uint64) * odd
    cell ^= cell >> np.uint64(32)
    mixed = (cell * np.uint64(0xD6E8FEB86659FD93)).reshape(len(x), tables, k).sum(axis=2, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(29)) ^ np.uint64(x.shape[1])).astype(np.int64)


def near_duplicate_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """``id_col``, n_links (other rows linked directly), component_id (least id reachable, its own included), kept.

    Two vectors are linked if their cosine is at least ``threshold``; of pairs exactly at it at least 99 in 100 are found,
    of nearer ones more, and none below it. Null or empty vectors, zero vectors, and those with null or non-finite
    components link with nothing. Vectors of different lengths never link. Every row is a vector of its own, whether it
    repeats another or only shares its id; a row without an id links like others, and is kept only where no row it can reach
    has an id. Other columns are not read; an empty table gives an empty result.
    """
    bounded_batches(vectors.sparkSession)
    v = F.col("v")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = given.withColumn("node", F.when(fine, digest("v")))
    few = [F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v")]
    nodes = written(rows.filter("node is not null").groupBy("node").agg(*few))
    n_rows, n_nodes = (int(x or 0) for x in nodes.agg(F.sum("copies"), F.count("*")).first())
    k, tables = plan(n_nodes, threshold)

    def units(raw: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and unit vectors, by vector length."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            x = np.stack([np.asarray(raw[p], np.float64) for p in at.tolist()])
            x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
            yield at, x / np.linalg.norm(x, axis=1, keepdims=True)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 2048):
                part = pdf.iloc[start : start + 2048]
                for at, x in units(part["v"].tolist()):
                    yield pd.DataFrame(
                        {
                            "node": part["node"].to_numpy()[at],
                            "copies": part["copies"].to_numpy()[at],
                            "unit": [u.tobytes() for u in x],
                            "keys": [q.tobytes() for q in keys(x, k, tables)],
                        }
                    )

    def memberships(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 2048):
                part = pdf.iloc[start : start + 2048]
                key = np.frombuffer(b"".join(part["keys"]), np.int64)
                yield pd.DataFrame({"band": np.tile(np.arange(tables, dtype=np.int32), len(part)), "key": key, "node": np.repeat(part["node"].to_numpy(), tables)})

    def verify(unit: pd.DataFrame) -> pd.DataFrame | None:
        band, i, j = int(unit["band"].iloc[0]), int(unit["i"].iloc[0]), int(unit["j"].iloc[0])
        raw = [np.frombuffer(u) for u in unit["unit"]]
        if len({len(u) for u in raw}) > 1:  # of a hash collision between lengths: nothing is linked across
            return pd.concat([verify(unit[[len(u) == size for u in raw]]) for size in sorted({len(u) for u in raw})])
        x = np.stack(raw)
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        first = linked_groups(linked)
        side = unit["side"].to_numpy()
        counted = linked & (side[:, None] != side[None, :]) if i != j else linked
        a, b = np.nonzero(np.triu(counted))
        if len(a) and band:
            q = np.frombuffer(b"".join(unit["keys"]), np.int64).reshape(len(x), tables)
            new = np.ones(len(a), bool)
            for s in range(0, len(a), 1 << 14):  # met before in a table of lower number: counted there
                part = slice(s, s + (1 << 14))
                new[part] = ~(q[a[part], :band] == q[b[part], :band]).any(axis=1)
            a, b = a[new], b[new]
        copies = unit["copies"].to_numpy()
        n = np.bincount(a, weights=copies[b], minlength=len(x)) + np.bincount(b, weights=copies[a], minlength=len(x))
        told = np.flatnonzero((n > 0) | (first != np.arange(len(x))))
        node = unit["node"].to_numpy()
        return pd.DataFrame({"a": node[told], "b": node[first[told]], "n": n[told].astype(np.int64)})

    signed = written(nodes.mapInPandas(hashed, "node binary, copies long, unit binary, keys binary"))
    members = signed.select("node", "keys").mapInPandas(memberships, "band int, key long, node binary")
    shared = shared_buckets(members, n_nodes * tables)
    links = written(in_units(blocks(shared).join(signed, "node")).mapInPandas(by_unit(verify), "a binary, b binary, n long"))
    counted = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    found = components(links.filter("a <> b").select("a", "b"))
    placed = nodes.select("node", "least", "copies").join(counted, "node", "left").join(found, "node", "left").withColumn("class", F.coalesce("component", "node"))
    classes = placed.groupBy("class").agg(F.min("least").alias("component_id"), F.count("*").alias("size"), F.lit(True).alias("any"))
    of_node = looked_up(placed.select("node", "class", "copies", F.coalesce("n", F.lit(0)).alias("n")), classes, on="class", count="size", total=n_nodes, values=["any", "component_id"], spread="node")
    told = of_node.select("node", "copies", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = looked_up(rows.select("id", "node"), told, on="node", count="copies", total=n_rows, values=["n_links", "component_id"], spread="id")
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    out = joined.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
