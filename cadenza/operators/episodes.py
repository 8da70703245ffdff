"""Segments that recordings share: a nearest-neighbour join of vectors between recordings, and runs of matches at one shift.

Equal vectors are one node. Nodes that lie close together share a bucket, the places of the largest of random projections, in at
least one of several tables with high probability; within a bucket cosines are exact. A second needs its few best matches only, and
leaving out its own recording takes at most ``best`` seconds from a list in which no recording has more. So a list of
twice as many, kept for each node, answers all seconds that have its vector, and nothing larger is ever gathered.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators.skew import matched
from cadenza.sources.tables import kept, stored

#: Nodes of a bucket's block; every two blocks of a larger bucket meet in one unit of work, and smaller buckets of about a quarter as many nodes share one.
BLOCK = 16_384
#: One node in so many is looked at to tell which buckets are large; that decides how work is divided, not what is found.
LOOKED = 16
#: Tables that are gone through at a time, after the first one.
ROUND = 4
#: Nodes whose records a task deals out at a time, and records that a partition gets on average.
CHUNK, DEALT = 65_536, 250_000
#: Nodes compared at a time, and hits after which the best are picked, if they aren't fewer than those picked before.
TILE, HITS = 512, 100_000
#: How a record holds the vector: as the first of these that holds it without loss.
KINDS = ("i1", "i2", "f4", "f8")
UNIT = ["tab", "dim", "unit", "i", "j"]
FOUND = "id long, bar double, others array<long>, cosines array<double>, videos array<int>, times array<int>"


@functools.lru_cache(16)
def _agreeing(m: int, cosine: float) -> float:
    """The probability, as estimated and less three standard errors, that of ``m`` random projections of two vectors with this cosine the same one is largest, with the same sign."""
    rng, n = np.random.default_rng([7, m]), 20_000
    same = 0
    for _ in range(10):
        x, z = rng.standard_normal((2, n // 10, m))
        y = cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * z
        same += int((_largest(x) == _largest(y)).sum())
    p = same / n
    return max(1e-4, p - 3 * math.sqrt(p * (1 - p) / n))


def plan(n: int, threshold: float, missed: float) -> tuple[tuple[int, int], int]:
    """Projections in each half of a key, in the first table and in others, and the number of tables for ``n`` vectors, so that pairs at the threshold are missed with this probability.

    Buckets of the first table are larger, so that it finds most of the best of nodes that have many near ones.
    """
    m = min(256, max(2, round(math.sqrt(n) / 24)))
    first = max(2, m // 4)
    missing = [math.log1p(-(_agreeing(k, threshold) ** 2)) for k in (first, m)]
    return (first, m), 1 + max(0, math.ceil((math.log(missed) - missing[0]) / missing[1]))


@functools.lru_cache(256)
def _planes(dim: int, m: int, table: int) -> np.ndarray:
    return np.random.default_rng([11, dim, table]).standard_normal((dim, 2 * m))


def _largest(p: np.ndarray) -> np.ndarray:
    """For each row the place of the component that is largest, whatever its sign, and the sign."""
    k = np.abs(p).argmax(axis=1)
    return 2 * k + (p[np.arange(len(p)), k] > 0)


def bucket_keys(x: np.ndarray, halves: tuple[int, int], tables: range) -> np.ndarray:
    """The key of each row of ``x`` in each table."""
    out = np.empty((len(x), len(tables)), np.int32)
    for s in range(0, len(x), 4096):
        for k, table in enumerate(tables):
            m = halves[table > 0]
            p = x[s : s + 4096] @ _planes(x.shape[1], m, table)
            out[s : s + 4096, k] = _largest(p[:, :m]) * (2 * m) + _largest(p[:, m:])
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision; where their squares may leave its range, each is divided by a power of two (so without rounding) that leaves its largest component below one."""
    x = x.astype(np.float64)
    most = np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x if ((most < 1e60) & (most > 1e-60)).all() else np.ldexp(x, -np.frexp(most)[1])


def _node(vector: Column) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), vector)), 16, "0") for seed in (1, 2)]))


def _first(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Nodes and their vectors, about CHUNK of them at a time and of one length."""

    def by_length(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        table = pa.Table.from_batches(held).combine_chunks()
        vectors = pa.concat_arrays(table["vector"].chunks) if table["vector"].num_chunks != 1 else table["vector"].chunk(0)
        sizes = np.diff(vectors.offsets.to_numpy())
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            flat = vectors.take(pa.array(at)).flatten() if len(at) < len(sizes) else vectors.flatten()
            yield table.take(pa.array(at)) if len(at) < len(sizes) else table, flat.to_numpy(zero_copy_only=False).reshape(len(at), dim)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield from by_length(held)
            held = []
    if sum(b.num_rows for b in held):
        yield from by_length(held)


def _record(kind: str, dim: int) -> np.dtype:
    return np.dtype([("id", "i8"), ("videos", "i8"), ("video", "i4"), ("t", "i4"), ("key", "i4"), ("bar", "f4"), ("x", kind, (dim,))])


def _records(table: pa.Table, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The nodes' places and records, for each of KINDS that some have."""
    left = np.arange(len(x))
    for code, kind in enumerate(KINDS):
        with np.errstate(all="ignore"):
            fits = (x[left].astype(kind) == x[left]).all(axis=1)
        at, left = left[fits], left[~fits]
        if len(at):
            records = np.empty(len(at), _record(kind, x.shape[1]))
            for name in ("id", "videos", "video", "t", "bar"):
                records[name] = table[name].to_numpy()[at]
            records["x"] = x[at]
            yield code, at, records


class _Unit:
    """The nodes of a unit of work, in which pairs are found and the best of them kept."""

    def __init__(self, parts: list[tuple[int, np.ndarray]], dim: int, threshold: float, best: int, halves: tuple[int, int], table: int, hits: int) -> None:
        self.threshold, self.best, self.halves, self.table, self.most = threshold, best, halves, table, hits
        self.margin = max(1e-5, 2e-7 * dim)  # of cosines in single precision
        whole = {name: np.concatenate([r[name] for _, r in parts]) for name in ("id", "videos", "video", "t", "key", "bar")}
        order = np.lexsort((-whole["bar"], whole["key"]))  # nodes with full lists first, whose tiles have few hits then
        self.id, self.videos, self.video, self.t, self.key, bar = (whole[name][order] for name in ("id", "videos", "video", "t", "key", "bar"))
        self.x = _scaled(np.concatenate([r["x"].astype(np.float64) for _, r in parts])[order])
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        self.unit = (self.x / np.sqrt(self.square)[:, None]).astype(np.float32)
        self.least = np.float32(threshold) - np.float32(self.margin)
        self.bar = np.maximum(self.least, bar - np.float32(self.margin))
        self.full, self.rank = np.zeros(len(self.id)), np.empty(len(self.id), np.int64)
        self.rank[np.argsort(self.id)] = np.arange(len(self.id))
        self.keys, self.keyed = np.empty((len(self.id), table), np.int32), np.zeros(len(self.id), bool)
        self.hits: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_hits = 0
        self.found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def meet(self, start: int, end: int, cut: int | None = None) -> None:
        """Compares the nodes from ``start`` to ``end`` with each other, or those before ``cut`` with the others."""
        for s in range(start, end if cut is None else cut, TILE):
            a = slice(s, min(s + TILE, end if cut is None else cut))
            for q in range(s if cut is None else cut, end, TILE):
                b = slice(q, min(q + TILE, end))
                cosine = self.unit[a] @ self.unit[b].T
                full = self.bar[a].max() > self.least and self.bar[b].max() > self.least
                close = cosine >= (np.minimum(self.bar[a, None], self.bar[None, b]) if full else self.least)
                at = np.flatnonzero(close)
                if not len(at):
                    continue
                r, c = at // close.shape[1], at % close.shape[1]
                c32, r, c = cosine[r, c], r + s, c + q
                if s == q and cut is None:
                    mine = (r != c) & (c32 >= self.bar[r])
                    self._add(r[mine], c[mine])
                else:
                    for one, other in ((r, c), (c, r)):
                        mine = c32 >= self.bar[one]
                        self._add(one[mine], other[mine])

    def _add(self, row: np.ndarray, col: np.ndarray) -> None:
        if len(row):
            self.hits.append((row, col))
            self.n_hits += len(row)
            if self.n_hits >= max(self.most, len(self.found[0])):
                self.settle()

    def settle(self) -> None:
        """Verifies the hits so far and keeps the best."""
        if not self.hits:
            return
        row, col = (np.concatenate(x) for x in zip(*self.hits, strict=True))
        self.hits, self.n_hits = [], 0
        if self.table:  # pairs that share a key of an earlier table met there
            new = np.unique(np.concatenate([row, col]))
            new = new[~self.keyed[new]]
            self.keys[new], self.keyed[new] = bucket_keys(self.x[new], self.halves, range(self.table)), True
            apart = np.concatenate([~(self.keys[row[k : k + 65536]] == self.keys[col[k : k + 65536]]).any(axis=1) for k in range(0, len(row), 65536)])
            row, col = row[apart], col[apart]
        dot = np.concatenate([np.empty(0), *[np.einsum("ij,ij->i", self.x[row[k : k + 65536]], self.x[col[k : k + 65536]]) for k in range(0, len(row), 65536)]])
        cosine = dot / np.sqrt(self.square[row] * self.square[col])
        near = cosine >= self.threshold
        old = self.found
        self.found = self._best(np.concatenate([old[0], row[near]]), np.concatenate([old[1], col[near]]), np.concatenate([old[2], np.round(cosine[near], 9)]))

    def _best(self, row: np.ndarray, col: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs that may be among the best of their row, and raises the bar of rows whose lists are full.

        Nodes are numbered by their first target, so pairs in the order of cosines and numbers are in that of their first targets. A pair
        is left out if ``best`` better ones have targets in all its recordings, or if first targets of better ones, ``best``
        of a recording, make twice as many.
        """
        order = _by_rank(row, cosine, self.rank[col], len(self.id))
        row, col, cosine = row[order], col[order], cosine[order]
        many = _many(row, self.video[col], self.best)
        if len(many):
            alone = self.videos[col[many]] & 1 == 1
            nth, _ = _nth([row[many], self.videos[col[many]]], [cosine[many]], self.t[col[many]], alone)
            told = np.ones(len(row), bool)
            told[many] = nth < self.best
            row, col, cosine = row[told], col[told], cosine[told]
        told, full = _capped(row, cosine, self.video[col], self.t[col], self.best)
        self.full[row[full]] = cosine[full]
        self.bar[row[full]] = np.maximum(self.bar[row[full]], (cosine[full] - self.margin).astype(np.float32))
        return row[told], col[told], cosine[told]

    def told(self) -> pa.RecordBatch:
        self.settle()
        row, col, cosine = self.found
        return _listed(self.id, self.full, row, self.id[col], cosine, self.video[col], self.t[col])


def _listed(number: np.ndarray, full: np.ndarray, row: np.ndarray, other: np.ndarray, cosine: np.ndarray, video: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
    """Rows FOUND of pairs in the order of ``row``, places in ``number`` and ``full``."""
    first = _starts(row)
    offsets = pa.array(np.r_[first, len(row)].astype(np.int32))
    of = row[first]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (other, cosine, video, t)]
    return pa.RecordBatch.from_arrays([pa.array(number[of]), pa.array(full[of]), *lists], ["id", "bar", "others", "cosines", "videos", "times"])


def _by_rank(row: np.ndarray, cosine: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """The order by rows, falling cosines of nine digits and ranks, all below ``n``."""
    if n > 1 << 16:
        return np.lexsort((rank, -cosine, row))
    far = np.rint((1 - cosine) * 1e9).clip(0).astype(np.uint64)  # at most 31 bits
    return np.argsort(row.astype(np.uint64) << np.uint64(47) | far << np.uint64(16) | rank.astype(np.uint64))


def _many(row: np.ndarray, video: np.ndarray, best: int) -> np.ndarray:
    """The places of pairs whose row has more than ``best`` with one recording."""
    keys = np.sort(row.astype(np.uint64) << np.uint64(32) | video.astype(np.uint32).astype(np.uint64))
    first = _starts(keys)
    rows = keys[first[np.diff(np.r_[first, len(keys)]) > best]] >> np.uint64(32)
    if not len(rows):
        return np.empty(0, np.int64)
    told = np.zeros(int(row.max()) + 1, bool)
    told[rows.astype(np.int64)] = True
    return np.flatnonzero(told[row])


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])


def _capped(row: np.ndarray, cosine: np.ndarray, video: np.ndarray, t: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs in the order of rows, falling cosines and numbers of nodes: those without 2 * ``best`` better first targets, ``best`` of a recording; and the pairs that fill a list."""
    counted = np.any([np.r_[True, x[1:] != x[:-1]][: len(x)] for x in (row, video, cosine, t)], axis=0)  # equal ones stand side by side
    many = _many(row, video, best)
    if len(many):
        nth, new = _nth([row[many], video[many]], [cosine[many]], t[many], np.ones(len(many), bool))
        counted[many] = new & (nth < best)
    total, first = np.cumsum(counted), _starts(row)
    before = total - counted - np.repeat(total[first] - counted[first], np.diff(np.r_[first, len(row)]))
    return before < 2 * best, counted & (before == 2 * best - 1)


def _merged(found: DataFrame, best: int, partitions: int) -> DataFrame:
    """One row FOUND for each node, with what may be among its best out of all its rows."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best_of(table: pa.Table) -> pa.RecordBatch:
            lists = [table[k].combine_chunks() for k in ("others", "cosines", "videos", "times")]
            lists = [x if isinstance(x, pa.ListArray) else x.chunk(0) for x in lists]
            other, cosine, video, t = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            ids = table["id"].to_numpy()
            first = _starts(ids)
            row = np.repeat(np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ids)])), np.diff(lists[0].offsets.to_numpy()))
            order = np.lexsort((other, -cosine, row))
            row, other, cosine, video, t = (x[order] for x in (row, other, cosine, video, t))
            told, last = _capped(row, cosine, video, t, best)
            full = np.zeros(len(first))
            full[row[last]] = cosine[last]
            return _listed(ids[first], full, row[told], other[told], cosine[told], video[told], t[told])

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            ids = table["id"].to_numpy()
            last = int(_starts(ids)[-1]) if len(ids) else 0
            if last:
                yield best_of(table.slice(0, last).combine_chunks())
            held = table.slice(last)
        if held is not None and held.num_rows:
            yield best_of(held.combine_chunks())

    return found.repartition(partitions, "id").sortWithinPartitions("id").mapInArrow(merged, FOUND)


def _nth(by: list[np.ndarray], values: list[np.ndarray], t: np.ndarray, timed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many different values stand before each item within its group, and whether its own is new; where ``timed``, times tell values apart too."""
    order = np.lexsort(by[::-1])  # stable, so the order within groups stays
    changed = lambda x: np.r_[True, x[order][1:] != x[order][:-1]][: len(order)]
    start = np.any([changed(x) for x in by], axis=0)
    new = start | np.any([changed(x) for x in values], axis=0) | (changed(t) & timed[order])
    total, first = np.cumsum(new), np.flatnonzero(start)
    nth = total - np.repeat(total[first], np.diff(np.r_[first, len(order)]))
    out, told = np.empty(len(order), np.int64), np.empty(len(order), bool)
    out[order], told[order] = nth, new
    return out, told


@contextmanager
def _removing(spark: SparkSession) -> Iterator[None]:
    """Queries run meanwhile remove their shuffles when they end, and send Python small batches."""
    values = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _large(nodes: DataFrame, n_nodes: int, halves: tuple[int, int], tables: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By table and length, the keys of buckets of more than about BLOCK nodes, and their numbers of blocks: at most one in BLOCK of all nodes and tables.

    One node in LOOKED is counted, and not what a task has few of, so a larger bucket may pass as a small one, by about a quarter.
    """
    if n_nodes <= BLOCK:
        return {}
    tasks = max(1, nodes.rdd.getNumPartitions() // LOOKED)
    least = BLOCK // (LOOKED * 4 * tasks)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], np.ndarray] = {}
        for _, x in _chunks(batches):
            for k, keys in enumerate(bucket_keys(_scaled(x), halves, range(tables)).T):
                n = np.bincount(keys, minlength=4 * halves[k > 0] ** 2).astype(np.int32)
                counts[k, x.shape[1]] = counts[k, x.shape[1]] + n if (k, x.shape[1]) in counts else n
        for (k, dim), n in counts.items():
            keys = np.flatnonzero(n > least)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), v, np.int32)) for v in (k, dim)] + [pa.array(keys.astype(np.int32)), pa.array(n[keys].astype(np.int64))], ["tab", "dim", "key", "n"])

    looked = nodes.filter(F.col("id") % LOOKED == 0).select("vector").coalesce(tasks)
    sums = looked.mapInArrow(counted, "tab int, dim int, key int, n long").groupBy("tab", "dim", "key").agg((F.sum("n") * LOOKED).alias("n"))
    by: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in sums.filter(F.col("n") > BLOCK).collect():
        by.setdefault((r["tab"], r["dim"]), []).append((r["key"], math.ceil(r["n"] / BLOCK)))
    return {of: tuple(np.array(x) for x in zip(*sorted(found), strict=True)) for of, found in by.items()}


def _near_nodes(nodes: DataFrame, n_nodes: int, threshold: float, best: int, missed: float) -> DataFrame:
    """Rows FOUND: near nodes found in shared buckets, with all that may be among a node's best.

    The first table alone shows which nodes have full lists; later tables look for better ones only. They are gone through ROUND
    at a time, and what they found is kept, so the nodes of all tables never lie on disk at once: a round's shuffles are removed when its query ends.
    """
    halves, tables = plan(n_nodes, threshold, missed)
    large = _large(nodes, n_nodes, halves, tables)
    partitions = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_nodes / DEALT))
    fresh = nodes.select("id", "vector", "videos", "video", "t", F.lit(0.0).cast("float").alias("bar"))
    rounds = [kept(_near_of(fresh, n_nodes, threshold, best, halves, range(1), large))]
    if tables > 1:
        bars = _merged(rounds[0], best, partitions).filter("bar > 0").select("id", (F.col("bar") - 1e-7).cast("float").alias("bar"))
        barred = stored(fresh.drop("bar").join(bars, "id", "left").fillna(0.0, ["bar"]))
        rounds += [kept(_near_of(barred, n_nodes, threshold, best, halves, range(k, min(k + ROUND, tables)), large)) for k in range(1, tables, ROUND)]
    return _merged(functools.reduce(DataFrame.union, rounds), best, partitions)


def _near_of(nodes: DataFrame, n_nodes: int, threshold: float, best: int, halves: tuple[int, int], of: range, large: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """What the tables ``of`` find that no earlier one does.

    A task deals its nodes out to units of work, all that go to one unit in a row.
    """
    groups, hits = max(1, 4 * n_nodes // BLOCK), HITS

    def units(key: np.ndarray, number: np.ndarray, tab: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Places, and for each of them: unit, i, j and what tells its nodes apart there, the key or the block."""
        at, small = np.arange(len(key)), np.full(len(key), -1)
        if (tab, dim) not in large:
            return at, np.column_stack([key % groups, small, small, key])
        keys, blocks = large[tab, dim]
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        many = keys[k] == key
        out = [(at[~many], np.column_stack([key % groups, small, small, key])[~many])]
        mine, count = at[many], blocks[k[many]]
        side = (number[mine] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % count
        for other in range(int(count.max(initial=0))):
            there = other < count
            i, j = np.minimum(side, other)[there], np.maximum(side, other)[there]
            out.append((mine[there], np.column_stack([key[mine[there]], i, j, side[there]])))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, x in _chunks(batches):
            dim, keys = x.shape[1], bucket_keys(_scaled(x), halves, of)
            for code, at, records in _records(table, x):
                for k, tab in enumerate(of):
                    places, unit = units(keys[at, k].astype(np.int64), records["id"].astype(np.uint64), tab, dim)
                    order = np.lexsort((unit[:, 2], unit[:, 1], unit[:, 0]))
                    places, unit = places[order], unit[order]
                    edges = np.r_[0, np.flatnonzero((unit[1:, :3] != unit[:-1, :3]).any(axis=1)) + 1, len(unit)]
                    rows = records[places]
                    rows["key"] = unit[:, 3]
                    first = unit[edges[:-1]]
                    blobs = [bytes([code]) + rows[s:e].tobytes() for s, e in zip(edges[:-1], edges[1:], strict=True)]
                    same = [np.full(len(blobs), v, np.int32) for v in (tab, dim)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*same, *first[:, :3].astype(np.int32).T.copy())] + [pa.array(blobs, pa.binary())], [*UNIT, "nodes"])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(of: tuple[int, ...], parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            tab, dim, _, i, j = of
            unit = _Unit(parts, dim, threshold, best, halves, tab, hits)
            edges = np.r_[0, np.flatnonzero(unit.key[1:] != unit.key[:-1]) + 1, len(unit.key)].tolist()
            if i == j:
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    if e - s > 1:
                        unit.meet(s, e)
            elif len(edges) == 3:
                unit.meet(0, edges[2], edges[1])
            return unit.told()

        now: tuple[int, ...] | None = None
        parts: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            ids = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(UNIT))]).tolist()
            for this, blob in zip(map(tuple, ids), batch.column(len(UNIT)), strict=True):
                if now is not None and this != now:
                    yield ended(now, parts)
                    parts = []
                now, raw = this, blob.as_py()
                parts.append((raw[0], np.frombuffer(raw, _record(KINDS[raw[0]], this[1]), offset=1)))
        if now is not None:
            yield ended(now, parts)

    records = nodes.mapInArrow(dealt, "tab int, dim int, unit int, i int, j int, nodes binary")
    partitions = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_nodes * len(of) / DEALT))
    rows = records.repartition(partitions, *UNIT).sortWithinPartitions(*UNIT)
    return rows.mapInArrow(paired, FOUND)


def matches(vectors: DataFrame, *, threshold: float = 0.95, best: int = 20, missed: float = 0.005) -> DataFrame:
    """(video_id, t, other_id, other_t, cosine): for each second its ``best`` seconds of other recordings with at least this cosine.

    Of vectors (video_id, t, vector) repeated rows count once; a second without one, a vector with a null or non-finite component and one of zeros
    match nothing, and neither do vectors of different lengths. Higher cosines (to nine digits) come first, then lesser
    recordings and times. A pair at the threshold is missed with the probability ``missed``, equal vectors never.
    """
    v = F.col("vector")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    with _removing(vectors.sparkSession):
        seconds = vectors.select("video_id", F.col("t").cast("int").alias("t"), v.cast("array<double>").alias("vector")).filter(fine)
        each = stored(seconds.withColumn("node", _node(v)))
        rows = each.select("video_id", "t", "node").distinct()
        told = _first(rows.select("node", "video_id", "t"), ["node", "video_id"], [F.col("t")], best)
        targets = _first(told, ["node"], [F.col("video_id"), F.col("t")], 2 * best)
        listed = targets.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("video_id", "t"))).alias("targets"))
        counted = rows.groupBy("node").agg(F.count("*").alias("n"))
        of = F.array_distinct(F.transform("targets", lambda x: x["video_id"]))
        alone = (F.size(of) == 1).cast("long")
        named = each.groupBy("node").agg(F.first("vector").alias("vector")).join(listed, "node").join(counted, "node")
        lead = named.withColumns({"videos": F.xxhash64(of).bitwiseAND(F.lit(-2)).bitwiseOR(alone), "video": F.hash(F.col("targets")[0]["video_id"]), "t": F.col("targets")[0]["t"]})
        nodes = stored(lead.orderBy(F.col("targets")[0]["video_id"], F.col("t")).withColumn("id", F.monotonically_increasing_id()))
        near = _near_nodes(nodes, nodes.count(), threshold, best, missed)
        pairs = near.select("id", F.explode(F.arrays_zip("others", "cosines")).alias("x")).select("id", F.col("x.others").alias("other"), F.col("x.cosines").alias("cosine"))
        shown = lambda of: nodes.select(F.col("id").alias(of), F.explode("targets").alias("x")).select(of, F.col("x.video_id").alias("other_id"), F.col("x.t").alias("other_t"))
        others = pairs.join(shown("other"), "other").select("id", "cosine", "other_id", "other_t")
        own = shown("id").select("id", F.lit(1.0).alias("cosine"), "other_id", "other_t")
        order = [F.desc("cosine"), F.col("other_id"), F.col("other_t")]
        capped = _first(others.union(own).repartition("id").distinct(), ["id", "other_id"], order, best)
        found = F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "other_id", "other_t")))
        answers = kept(_first(capped, ["id"], order, 2 * best).groupBy("id").agg(found.alias("found")).join(nodes.select("id", "node", "n"), "id").select("node", "n", "found"))
    told = matched(rows, answers, ["node"], "n", rows.count())
    others = F.slice(F.filter("found", lambda x: x["other_id"] != F.col("video_id")), 1, best)
    each = told.select("video_id", "t", F.explode(others).alias("x"))
    return each.select("video_id", "t", "x.other_id", "x.other_t", (-F.col("x.far")).alias("cosine"))


def repeated_segments(match: DataFrame, least: int = 3) -> DataFrame:
    """(video_id, other_id, shift, start_sec, end_sec, n, cosine): stretches of at least ``least`` seconds that two recordings share.

    Matches (video_id, t, other_id, other_t, cosine) count in both directions, once. A stretch is a run of consecutive seconds of
    the lesser recording that all match the second ``shift`` later in the other; ``cosine`` is their mean.
    """
    forward = F.col("video_id") < F.col("other_id")
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    one_way = match.select(
        pick("video_id", "other_id").alias("video_id"), pick("other_id", "video_id").alias("other_id"), pick("t", "other_t").alias("t"), (pick("other_t", "t") - pick("t", "other_t")).alias("shift"), "cosine"
    ).distinct()
    pair = ["video_id", "other_id", "shift"]
    by_time = Window.partitionBy(*pair).orderBy("t")
    new = F.coalesce((F.col("t") - F.lag("t").over(by_time) > 1).cast("int"), F.lit(1))
    islands = one_way.withColumn("new", new).withColumn("island", F.sum("new").over(by_time))
    found = islands.groupBy(*pair, "island").agg(F.min("t").alias("start_sec"), (F.max("t") + 1).alias("end_sec"), F.count("*").alias("n"), F.avg("cosine").alias("cosine"))
    return found.filter(F.col("n") >= least).drop("island")
