"""Hard-negative mining by slot-decomposed selection (operator 11).

An anchor's positives each ask for the best negatives within a window of scores, and the windows overlap. Their upper limits
cut the scores into disjoint slots. Every task keeps the best of each slot it has seen, tasks' slots are merged, and a merge
from the lowest slot upwards answers all windows: the rows below a positive's limit are those of its slot and of all lower
ones, in this order, and its lower limit ends the list.

Anchors meet all rows in units of work: a part of the anchors, held in memory, and a part of the rows, streamed past them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.lineage import bounded_batches, written

#: Anchors that a unit of work holds.
ANCHORS = 4096
#: Rows that a unit of work streams, at most about this many.
ROWS = 1 << 17
#: Scores that are computed at once.
_SCORES = 1 << 20
#: Components are clamped to this; scores beyond 64 bits count as the largest or least long.
_MOST = 1 << 62
_UNKNOWN = (1 << 63) - 1


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices, clamped to 64 bits."""
    if a.shape[1] == 0 or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    bound = a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max())
    if bound < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return np.clip(a.astype(object) @ b.astype(object).T, -_UNKNOWN, _UNKNOWN).astype(np.int64)


class _Best:
    """The first ``k`` (score descending, id ascending) of each of many lists, as entries come."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.least = np.full(lists, -_UNKNOWN - 1)
        self.held = [np.empty(0, np.int64)] * 3

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        new = score >= self.least[at]
        at, score, ids = (np.concatenate([h, x[new]]) for h, x in zip(self.held, (at, score, ids), strict=True))
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        full = rank == self.k - 1
        self.least[at[full]] = score[full]
        self.held = [x[rank < self.k] for x in (at, score, ids)]


class _Unit:
    """The anchors of a unit that have vectors of one length, and what they have found."""

    def __init__(self, anchors: pd.DataFrame, k: int):
        self.uid, self.label = anchors["uid"].to_numpy(), anchors["label"].to_numpy()
        self.q = _matrix(anchors["q"])
        self.limits = [np.asarray(x, np.int64) for x in anchors["limits"]]
        self.slots = max(map(len, self.limits))
        self.floor = anchors["floor"].to_numpy()
        self.best = _Best(len(anchors) * max(self.slots, 1), k)

    def positives(self, uid: np.ndarray, label: np.ndarray, q: np.ndarray, ids: np.ndarray) -> None:
        for value in np.intersect1d(self.label, label):
            mine, theirs = np.flatnonzero(self.label == value), np.flatnonzero(label == value)
            score = _dots(self.q[mine], q[theirs])
            a, c = np.nonzero((score >= self.best.least[mine][:, None]) & (self.uid[mine][:, None] != uid[theirs][None, :]))
            self.best.add(mine[a], score[a, c].astype(np.int64), ids[theirs[c]])

    def negatives(self, uid: np.ndarray, label: np.ndarray, q: np.ndarray, ids: np.ndarray) -> None:
        limits = np.full((len(self.uid), self.slots), -_UNKNOWN - 1)
        for k, x in enumerate(self.limits):
            limits[k, : len(x)] = x
        score = _dots(self.q, q)
        a, c = np.nonzero((score <= limits[:, :1]) & (score >= self.floor[:, None]) & (self.label[:, None] != label[None, :]))
        found = score[a, c].astype(np.int64)
        slot = (found[:, None] <= limits[a]).sum(axis=1) - 1  # limits fall from slot to slot
        self.best.add(a * self.slots + slot, found, ids[c])

    def told(self) -> pd.DataFrame:
        at, score, ids = self.best.held
        return pd.DataFrame({"uid": self.uid[at // max(self.slots, 1)], "slot": (at % max(self.slots, 1)).astype(np.int32), "score": score, "id": ids})


def _matrix(q: pd.Series) -> np.ndarray:
    raw = b"".join(q)
    return np.frombuffer(raw, np.int64).reshape(len(q), -1) if raw else np.empty((len(q), 0), np.int64)


def _searched(scan: str, k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over rows sorted by part, group and side: in each unit the anchors come first, then the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, waiting, states = None, [], None

        def ended() -> Iterator[pd.DataFrame]:
            for state in (states or {}).values():
                yield state.told()

        for pdf in batches:
            keys = pdf[["part", "group", "side"]].to_numpy()
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if start == end:
                    continue
                rows = pdf.iloc[start:end]
                if (now := tuple(keys[start][:2])) != unit:
                    yield from ended()
                    unit, waiting, states = now, [], None
                if keys[start][2] == 0:
                    waiting.append(rows)
                    continue
                if states is None:
                    anchors = pd.concat(waiting) if waiting else rows.iloc[:0]
                    states = {size: _Unit(x, k) for size, x in anchors.groupby(anchors["q"].map(len))}
                    waiting = []
                for size, x in rows.groupby(rows["q"].map(len)):
                    if (state := states.get(size)) is None:
                        continue
                    step = max(1, _SCORES // len(state.uid))
                    for s in range(0, len(x), step):
                        y = x.iloc[s : s + step]
                        getattr(state, scan)(y["uid"].to_numpy(), y["label"].to_numpy(), _matrix(y["q"]), y["id"].to_numpy())
        yield from ended()

    return run


def _units(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int) -> DataFrame:
    """Every anchor with every row, in units: ``part`` numbers the anchors' parts and ``group`` the rows'."""
    parts = -(-n_anchors // ANCHORS)
    groups = max(-(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // parts), -(-n_rows // ROWS))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")

    held = anchors.select("uid", "id", "label", "q", "limits", "floor", F.lit(0).alias("side"), dealt(parts).alias("part"), every(groups).alias("group"))
    none = F.array().cast("array<long>")
    passing = rows.select("uid", "id", "label", "q", none.alias("limits"), F.lit(0).cast("long").alias("floor"), F.lit(1).alias("side"), every(parts).alias("part"), dealt(groups).alias("group"))
    return held.union(passing).repartition("part", "group").sortWithinPartitions("part", "group", "side")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    return found.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).filter(F.col("nth") <= k)


def hard_negatives(
    vectors: DataFrame,
    *,
    anchor: Column | str,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    n_positives: int = 5,
    n_negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x), in double; a score is the integer inner product with the anchor, higher ones and
    then smaller ids first. Anchors are the rows where ``anchor`` holds. Each has its first ``n_positives`` other rows of the
    same label as positives, and each of these the first ``n_negatives`` rows of other labels whose score lies between ``low``
    and ``high`` per cent of the positive's, both included. Positives below 0 have an empty window.

    Rows with a null label, a null vector or null or non-finite components take no part; vectors of different lengths don't meet,
    empty ones score 0. Each row stands for itself, also where rows or ids repeat: another row with an anchor's id may be its
    positive. A null id is no anchor, comes last in ties and is told as null. Components beyond 2**62 count as that, scores beyond
    64 bits as the largest or least one. Other columns are not read; without anchors the result is empty.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    v = F.col("v")
    fine = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    is_anchor = F.coalesce(F.expr(anchor) if isinstance(anchor, str) else anchor, F.lit(False)) & F.col(id_col).isNotNull()
    given = vectors.select(
        F.monotonically_increasing_id().alias("uid"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_UNKNOWN)).alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
        is_anchor.alias("anchor"),
    )

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            with np.errstate(over="ignore"):
                q = [np.clip(np.floor(np.asarray(x, np.float64) * scale), -float(_MOST), float(_MOST)).astype(np.int64).tobytes() for x in pdf["v"]]
            yield pdf[["uid", "id", "label", "anchor"]].assign(q=q)

    table = written(given.filter(fine).mapInPandas(packed, "uid long, id long, label long, anchor boolean, q binary"))
    rows, anchors = table.drop("anchor"), table.filter("anchor").drop("anchor")
    n_rows, n_anchors = table.count(), anchors.count()
    told = "uid long, slot int, score long, id long"
    # an anchor's lists and limits are bounded by n_positives and n_negatives, so all that is gathered of one is small
    none, least = F.array().cast("array<long>").alias("limits"), F.lit(-_UNKNOWN - 1).alias("floor")
    first = _units(anchors.select("*", none, least), rows, max(n_anchors, 1), n_rows).mapInPandas(_searched("positives", n_positives), told)
    positives = written(_first(first, ["uid"], n_positives).select("uid", F.col("id").alias("positive_id"), F.col("score").alias("p")).filter("p >= 0"))
    exact = F.col("p").cast("decimal(38,0)")
    whole = lambda x: F.floor(x).cast("long")
    windows = positives.select("uid", "positive_id", "p", whole(exact * high / 100).alias("upper"), (-whole(-exact * low / 100)).alias("lower"))
    limits = windows.groupBy("uid").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("limits"), F.min("lower").alias("floor"))
    second = _units(anchors.join(limits, "uid"), rows, max(n_anchors, 1), n_rows).mapInPandas(_searched("negatives", n_negatives), told)
    slots = _first(second, ["uid", "slot"], n_negatives).groupBy("uid").agg(F.collect_list(F.struct("slot", "nth", "score", "id")).alias("found"))
    asked = windows.groupBy("uid").agg(F.collect_list(F.struct("upper", "lower", "p", "positive_id")).alias("windows"))
    answered = slots.join(asked, "uid").join(limits, "uid").join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid")

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                slot: dict[int, list] = {}
                for x in sorted(row.found, key=lambda x: (x["slot"], x["nth"])):
                    slot.setdefault(x["slot"], []).append((x["score"], x["id"]))
                below, of_limit = [], {}
                for k in range(len(row.limits) - 1, -1, -1):
                    below = [*slot.get(k, []), *below][:n_negatives]
                    of_limit[row.limits[k]] = below
                for w in row.windows:
                    inside = [x for x in of_limit[w["upper"]] if x[0] >= w["lower"]]
                    out += [(row.anchor_id, w["positive_id"], k + 1, i, w["p"], s) for k, (s, i) in enumerate(inside)]
            yield pd.DataFrame(out, columns=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    result = answered.mapInPandas(merged, schema)
    return result.withColumns({c: F.when(F.col(c) != _UNKNOWN, F.col(c)) for c in ("positive_id", "negative_id")})


#: The rows of op11_hard_negatives in DuckDB.
HARD_NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v AS a, v AS b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 10
"""
