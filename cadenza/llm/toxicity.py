"""Toxicity by compression distance (operator 5).

Two zstandard dictionaries are trained, one on ordinary and one on toxic text, and every window of a text is compressed
with both: a window that the toxic dictionary shortens by more than a calibrated threshold counts as a hit. Texts are
compressed in word code, sixteen bytes of hash for every word, so that a word that a dictionary knows saves the same number
of bytes whether it is short or long, and parts of other words save nothing. The toxic dictionary carries the ordinary
one's content too, so the two differ only in what toxic text adds: its words that are over-represented against ordinary
text by a likelihood ratio, near copies in the sample counting once. Hits and saved bytes give a score by a logistic fit.

Fitting takes at most TOXIC + ORDINARY labelled rows, drawn by the hash of their id, and of these all words; the ordinary
dictionary is trained on at most about SAMPLED_WINDOWS windows, drawn evenly from all of them, and the toxic one holds at
most as many words as fit in TOXIC_BYTES. Scoring compresses all windows of all texts.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.lineage import bounded_batches, written
from cadenza.llm.shingles import shingles, word_hashes
from cadenza.llm.totals import slices, summed

TOXIC, ORDINARY, SAMPLED_WINDOWS = 3000, 6000, 100_000
WINDOW = 8
DICTIONARY_BYTES, TOXIC_BYTES = 16_384, 65_536
LEVEL = 3
#: Histogram of saved bytes, from -REACH to REACH: a window in word code has so many, and a few of frame.
REACH = 16 * WINDOW + 16
#: Of ordinary windows at most this fraction may count as hits. A window with one telling word saves about 13 bytes.
FALSE_HITS = 1e-3
#: How many times as common among toxic documents a telling word is, at least.
LEAST_RATE = 10
#: By how much a telling word's likelihood ratio exceeds the logarithm of the number of words, so that exp(-SURE) words are told by chance.
SURE = 3
_BANDS, _ROWS = 6, 3


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int
    weights: tuple[float, ...]

    def score(self, histogram: np.ndarray) -> float:
        return float(1 / (1 + math.exp(-float(np.clip(features(histogram, self.threshold) @ np.array(self.weights), -30, 30)))))


def features(histogram: np.ndarray, threshold: int) -> np.ndarray:
    over = histogram[REACH + threshold :]
    return np.array([1.0, math.log1p(over.sum()), math.log1p(float(over @ np.arange(threshold, REACH + 1)))])


@functools.lru_cache(4)
def _compressors(ordinary: bytes, toxic: bytes) -> tuple:
    import zstandard

    out = []
    for content in (ordinary, toxic):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
    return tuple(out)


def coded(words: np.ndarray) -> bytes:
    """Word code: each word's hash and its product with an odd number."""
    return np.stack([words, (words ^ words >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)], axis=1).tobytes()


def saved_bytes(text: str, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """For each number of bytes that the toxic dictionary saves against the ordinary one, the windows of ``text`` with it."""
    by_ordinary, by_toxic = (c.compress for c in _compressors(ordinary, toxic))
    raw = coded(word_hashes(text))
    out = np.zeros(2 * REACH + 1, np.int64)
    step = 16 * WINDOW
    found = [len(by_ordinary(w)) - len(by_toxic(w)) for w in (raw[k : k + step] for k in range(0, len(raw), step))]
    if found:
        np.add.at(out, np.clip(found, -REACH, REACH) + REACH, 1)
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content that zstandard's trainer picks from the samples; of samples too few to train on, all of them."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)


def _first_copies(bands: np.ndarray) -> np.ndarray:
    """Which rows share no band with an earlier row that stays."""
    seen: list[set] = [set() for _ in range(bands.shape[1])]
    keep = []
    for row in bands.tolist():
        keep.append(all(b not in s for b, s in zip(row, seen, strict=True)))
        if keep[-1]:
            for b, s in zip(row, seen, strict=True):
                s.add(b)
    return np.array(keep, bool)


def over_represented(counts: DataFrame, toxic: int, ordinary: int) -> list[int]:
    """Words of ``counts`` (word, in_toxic, in_ordinary: documents with it) that stand out in toxic documents by their
    likelihood ratio among all words of the sample, the most telling first; as many as fit in the dictionary."""
    n_words = counts.count()
    rate = (F.col("in_toxic") / max(toxic, 1)) / ((F.col("in_ordinary") + 0.5) / (ordinary + 1))
    told = counts.filter("in_toxic > 1").withColumn("rate", rate).withColumn("ratio", F.col("in_toxic") * F.log(F.col("rate")))
    telling = told.filter((F.col("ratio") >= math.log(max(n_words, 2)) + SURE) & (F.col("rate") >= LEAST_RATE))
    return [r["word"] for r in telling.orderBy(F.desc("ratio"), "word").limit(TOXIC_BYTES // 16).collect()]


def is_held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic regression with a small ridge, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-9)) @ x + 1e-2 * np.eye(len(w)), gradient)
        w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return tuple(w.tolist())


def _drawn(told: DataFrame, n: int, size: int) -> DataFrame:
    """The ``n`` rows of the least hash; rows whose hash can't be among them are left out first, so few meet in one place."""
    likely = min(1.0, 1.3 * (n + 100) / max(size, 1))
    kept = told.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(likely * (1 << 30)))
    return kept.distinct().orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "id").limit(n)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """A model from the labelled rows that are not held out; None where either label is missing among them."""
    told = labels.select(F.col(id_col).alias("id"), (F.col(label_col) != 0).alias("toxic")).filter("id is not null and toxic is not null").filter(~is_held_out(F.col("id")))
    told = told.groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    drawn = [_drawn(told.filter(F.col("toxic") == toxic), n, sizes.get(toxic, 0)) for toxic, n in ((True, TOXIC), (False, ORDINARY))]
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labelled = texts.join(F.broadcast(drawn[0].union(drawn[1])), "id")  # at most TOXIC + ORDINARY rows
    chosen = labelled.groupBy("id").agg(F.min(F.struct("text", "toxic")).alias("least")).select("id", "least.*")  # one text for an id
    kind = texts.schema["id"].dataType.simpleString()

    def outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"].tolist():
                h = shingles(text)[0]
                least = [int((h * np.uint64(2 * k + 0x9E3779B97F4A7C15)).min()) if len(h) else k for k in range(_BANDS * _ROWS)]
                bands = np.array([hash(tuple(least[k : k + _ROWS])) for k in range(0, len(least), _ROWS)], np.int64)
                out.append((bands.tobytes(), word_hashes(text).tobytes()))
            yield pd.concat([pdf[["id", "toxic", "text"]], pd.DataFrame(out, columns=["bands", "words"], index=pdf.index)], axis=1)

    outlined = chosen.mapInPandas(outline, f"id {kind}, toxic boolean, text string, bands binary, words binary")
    sample = written(outlined)
    got = sample.select("id", "toxic", "bands").toPandas().sort_values("id", ignore_index=True)
    if got["toxic"].nunique() < 2:
        return None
    got = got[_first_copies(np.stack([np.frombuffer(b, np.int64) for b in got["bands"]]))]
    toxic = got["toxic"].to_numpy(bool)
    if toxic.all() or not toxic.any():
        return None
    first = docs.sparkSession.sparkContext.broadcast(set(got["id"]))  # at most TOXIC + ORDINARY ids
    coded_rows = sample.select("id", "toxic", "words")

    def occurring(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for id_, is_toxic, words in zip(pdf["id"].tolist(), pdf["toxic"].tolist(), pdf["words"], strict=True):
                if id_ in first.value:
                    yield pd.DataFrame({"word": np.unique(np.frombuffer(words, np.int64)), "toxic": is_toxic})

    seen = coded_rows.mapInPandas(occurring, "word long, toxic boolean")
    sums = [F.sum(F.col("toxic").cast("long")).alias("in_toxic"), F.sum((~F.col("toxic")).cast("long")).alias("in_ordinary")]
    telling = np.array(over_represented(written(seen.groupBy("word").agg(*sums)), int(toxic.sum()), int((~toxic).sum())), np.int64)
    n_windows = coded_rows.filter("not toxic").agg(F.sum(F.ceil(F.octet_length("words") / (8 * WINDOW)))).first()[0]
    share = min(1.0, SAMPLED_WINDOWS / max(int(n_windows or 0), 1))

    def samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for id_, is_toxic, words in zip(pdf["id"].tolist(), pdf["toxic"].tolist(), pdf["words"], strict=True):
                x = np.frombuffer(words, np.uint64)
                if id_ not in first.value or not len(x):
                    continue
                if is_toxic:  # the telling words, in the order of the text
                    out = [coded(x[np.isin(x.view(np.int64), telling)])]
                else:
                    starts = np.arange(0, len(x), WINDOW)
                    drawn = starts[np.random.default_rng(zlib.crc32(words)).random(len(starts)) < share]
                    out = [coded(x[k : k + WINDOW]) for k in drawn.tolist()]
                yield pd.DataFrame({"toxic": is_toxic, "sample": out})

    material = coded_rows.mapInPandas(samples, "toxic boolean, sample binary").toPandas()
    parts = {t: sorted(bytes(x) for x in material.loc[material["toxic"] == t, "sample"] if x) for t in (True, False)}
    ordinary = _trained(parts[False], DICTIONARY_BYTES)
    model = Model(ordinary, ordinary + _trained(parts[True], min(TOXIC_BYTES, max(DICTIONARY_BYTES // 2, 16 * len(telling)))), 1, (0.0, 0.0, 0.0))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [saved_bytes(t, model.ordinary, model.toxic).astype("<i8").tobytes() for t in pdf["text"].tolist()]
            yield pd.DataFrame({"toxic": pdf["toxic"], "saved": found})

    measured = written(sample.select("toxic", "text").mapInPandas(measure, "toxic boolean, saved binary"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * REACH + 1)
        for pdf in batches:
            for saved in pdf["saved"]:
                total += np.frombuffer(saved, "<i8")
        yield slices(total)

    ordinary_windows = summed(measured.filter("not toxic").mapInPandas(windows, "slice long, sums binary"), 2 * REACH + 1)
    tail = ordinary_windows[::-1].cumsum()[::-1] / max(ordinary_windows.sum(), 1)  # ordinary windows that save at least so much
    threshold = next((t for t in range(1, REACH) if tail[REACH + t] <= FALSE_HITS), REACH)

    def told_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "x": [features(np.frombuffer(s, "<i8"), threshold).tolist() for s in pdf["saved"]]})

    fitted = measured.mapInPandas(told_features, "toxic boolean, x array<double>").toPandas()
    fitted = fitted.sort_values("x", key=lambda c: c.map(tuple), ignore_index=True)
    return Model(model.ordinary, model.toxic, threshold, _logistic(np.stack(fitted["x"].map(np.asarray)), fitted["toxic"].to_numpy(float)))


def toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cut: float = 0.7
) -> DataFrame:
    """``id_col``, held_out, score (0 to 1) and predicted (1 if score >= ``cut``) for every row of ``docs``.

    A null, empty or wordless text has no window and gets the score of no hits. Without labels of both kinds every score is
    0.5. Rows may repeat and ids may be null (never held out). Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = [model.score(saved_bytes(t, model.ordinary, model.toxic)) if model else 0.5 for t in pdf["text"].tolist()]
            yield pd.DataFrame({"id": pdf["id"], "score": scores})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = rows.mapInPandas(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), is_held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cut: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, with all their columns, as ``toxicity`` scores them."""
    bounded_batches(docs.sparkSession)
    import pyarrow as pa

    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            yield batch.filter(pa.array([model.score(saved_bytes(t or "", model.ordinary, model.toxic)) < cut for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
