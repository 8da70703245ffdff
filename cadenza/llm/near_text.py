"""Near-duplicate texts by consistent weighted sampling of TF-IDF shingles (operator 1).

A text is the weighted set of its shingles of five words; a weight is the shingle's count times its inverse document
frequency. Document frequencies are counted over all documents in a table of fixed size, addressed by the shingle's hash:
a cell that rare shingles share holds the same fraction of the documents at any size of the corpus, so weights do not
drift as it grows. In a large group of near copies what they share weighs less than what was changed, so texts are also
compared by their counts alone, which no group's size moves. Samples of the weighted and of the plain sets are banded. In
a bucket the pairs of every block of bounded size are verified by both exact Jaccard similarities, together with one lead;
whatever isn't connected with the lead is then verified against the whole bucket, so no class loses a link. Blocks return
spanning links only. Exact copies are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.candidates import by_unit, in_units, linked_groups, loose_blocks, shared_buckets, stars
from cadenza.llm.components import components
from cadenza.llm.joins import looked_up
from cadenza.llm.lineage import bounded_batches, written
from cadenza.llm.shingles import CELLS, cells, idf, shingles, weighted_samples
from cadenza.llm.tokens import release
from cadenza.llm.totals import slices, summed

THRESHOLD, BANDS, ROWS = 0.8, 7, 3


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with a shingle in each cell of the table, and the number of documents.

    The driver gets CELLS numbers, however many documents there are.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        total = np.zeros(CELLS + 1)  # the last number counts the documents
        for pdf in batches:
            total[CELLS] += len(pdf)
            for text in pdf["text"]:
                total[np.unique(cells(shingles(text)[0]))] += 1
        yield slices(total)

    total = summed(texts.mapInPandas(count, "slice long, sums binary"), CELLS + 1)
    return total[:CELLS], int(total[CELLS])


def similarities(sets: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs of ``sets`` (hashes, counts); an element's weight is count x weight[cell]."""
    sizes = [len(h) for h, _ in sets]
    every, count = np.concatenate([h for h, _ in sets]), np.concatenate([c for _, c in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    total = np.bincount(row, weights=count * weight[cells(every)], minlength=len(sets))
    element, at, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    row, col, count = row[keep], column[at[keep]], count[keep]
    w = weight[cells(element[shared])]
    order = np.argsort(col, kind="stable")
    row, col, count = row[order], col[order], count[order]
    least = np.zeros((len(sets), len(sets)))
    wide = 4096
    for start in range(0, len(w), wide):
        s, e = np.searchsorted(col, [start, start + wide])
        r, c, k = row[s:e], col[s:e] - start, count[s:e]
        below = 0
        for level in np.unique(k).tolist():  # min(x, y) is the number of levels that both reach
            up = k >= level
            used, c_at = np.unique(c[up], return_inverse=True)
            m = np.zeros((len(sets), len(used)))
            m[r[up], c_at] = 1.0
            least += (m * (w[start + used] * (level - below))) @ m.T
            below = level
    out = least / np.maximum(total[:, None] + total[None, :] - least, 1e-300)
    np.fill_diagonal(out, 1.0)  # what only one set holds is left out above
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, component_id (least id of the document's class) and kept (whether the row stands for its class).

    Two documents are linked if their texts are equal or their Jaccard similarity, weighted or by counts alone, is at least
    ``threshold``; a class is what links connect. Null, empty and blank texts are like nothing and form classes of their own. Texts of fewer
    than five words are one shingle, those without any word equal only their copies. Rows with the same id share its
    outcome. Rows with a null id never stand for others and are kept only where their class has no id. Other columns are
    not read; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = given.select("id", "text", F.when(F.col("text").rlike(r"\S"), F.unhex(F.md5("text"))).alias("node"))
    counts, n_docs = document_frequencies(given.select("text"))
    weight = spark.sparkContext.broadcast(idf(counts, n_docs))  # CELLS numbers
    kind = rows.schema["id"].dataType.simpleString()

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        w = weight.value
        for pdf in batches:
            keys: dict[bytes, np.ndarray | None] = {None: None}
            for node, text in zip(pdf["node"].tolist(), pdf["text"].tolist(), strict=True):
                if node not in keys:
                    h, c = shingles(text)
                    keys[node] = band_keys([weighted_samples(h, x, BANDS * ROWS) for x in (c * w[cells(h)], c)]) if len(h) else None
            yield pd.DataFrame({"id": pdf["id"], "node": pdf["node"], "keys": [keys[n] for n in pdf["node"].tolist()]})

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in batches:
            sets = [shingles(t) for t in pdf["text"].tolist()]
            counts = [b"" if (c == 1).all() else c.astype("<u4").tobytes() for _, c in sets]
            yield pd.DataFrame({"node": pdf["node"], "hashes": [h.tobytes() for h, _ in sets], "counts": counts})

    def groups(unit: pd.DataFrame) -> np.ndarray:
        sets = []
        for h, c in zip(unit["hashes"], unit["counts"], strict=True):
            h = np.frombuffer(h, np.uint64)
            sets.append((h, np.frombuffer(c, "<u4").astype(np.int64) if c else np.ones(len(h), np.int64)))
        return linked_groups((similarities(sets, weight.value) >= threshold) | (similarities(sets, np.broadcast_to(1.0, CELLS)) >= threshold))

    def links_of(unit: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        node = unit["node"].to_numpy()
        more = np.flatnonzero(first != np.arange(len(node)))
        return pd.DataFrame({"a": node[more], "b": node[first[more]]})

    def verify_star(unit: pd.DataFrame) -> pd.DataFrame | None:
        first = groups(unit)
        out = links_of(unit, first)
        if unit["wide"].iloc[0]:
            lead = min(np.flatnonzero(unit["lead"].to_numpy()).tolist(), key=unit["node"].tolist().__getitem__)
            apart = unit.loc[first != first[lead], ["band", "key", "node"]].rename(columns={"node": "a"})
            out = pd.concat([out, apart], ignore_index=True)
        return out.reindex(columns=["a", "b", "band", "key"]).astype({"band": "Int32", "key": "Int64"})

    def verify_loose(unit: pd.DataFrame) -> pd.DataFrame | None:
        return links_of(unit, groups(unit))

    signed = written(rows.mapInPandas(sample, f"id {kind}, node binary, keys array<long>"))
    nodes = written(signed.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("keys", ignorenulls=True).alias("keys")))
    members = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    total = 2 * BANDS * nodes.count()
    shared = written(shared_buckets(members.select("band", "key", "node"), total))
    wanted = shared.select("node").distinct()
    # copies are dropped before texts are dealt out, so a text with very many of them meets nowhere
    texts = rows.select("node", "text").filter("node is not null").dropDuplicates(["node"]).join(wanted, "node", "left_semi")
    sets = written(texts.mapInPandas(features, "node binary, hashes binary, counts binary"))
    told = written(in_units(stars(shared).join(sets, "node")).mapInPandas(by_unit(verify_star), "a binary, b binary, band int, key long"))
    links = told.filter("b is not null").select("a", "b")
    loose = told.filter("b is null").select("band", "key", F.col("a").alias("node"))
    if not loose.isEmpty():  # nodes of wide buckets that aren't connected with its lead meet the whole bucket
        links = written(links.union(in_units(loose_blocks(shared, loose, total).join(sets, "node")).mapInPandas(by_unit(verify_loose), "a binary, b binary")))
    found = components(links)
    placed = nodes.select("node", "least", "n").join(found, "node", "left").withColumn("class", F.coalesce("component", "node"))
    classes = placed.groupBy("class").agg(F.min("least").alias("component_id"), F.sum("n").alias("n"), F.lit(True).alias("any"))
    of_node = looked_up(placed.select("node", "class", F.col("n").alias("rows")), classes, on="class", count="n", total=n_docs, values=["any", "component_id"], spread="node")
    joined = looked_up(signed.select("id", "node"), of_node.select("node", "any", "component_id", "rows"), on="node", count="rows", total=n_docs, values=["any", "component_id"], spread="id")
    component = F.when(F.col("any"), F.col("component_id")).otherwise(F.col("id"))
    out = joined.select("id", component.alias("component_id"))
    return out.select(F.col("id").alias(id_col), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def band_keys(samples: list[np.ndarray]) -> np.ndarray:
    """One key for every ROWS samples, those of the weighted set first, then those of the plain one."""
    parts = np.concatenate(samples).astype(np.float32).view(np.uint32).astype(np.uint64).reshape(-1, ROWS)
    key = np.zeros(len(parts), np.uint64)
    for k in range(ROWS):
        key = (key ^ parts[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.astype(np.int64)


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stand for their class, with all their columns; rows with the same id stay or go together."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, threshold=threshold).filter("kept").select(F.col(id_col).alias("_kept"))
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept"]), "left_semi")
