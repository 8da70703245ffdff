"""Token counts by rank-synchronous array merging (operator 8).

A text is cut where no piece of the vocabulary can cross: before each run of the space mark, and around line feeds if
no piece holds one. The distinct pre-tokens of a batch become one ragged numpy array of symbols; in every round each
pre-token applies its lowest-rank pair (leftmost of equals), all pre-tokens at the same time, until no pair is left.
Surviving symbols are counted, unknown characters as their UTF-8 bytes.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.lineage import bounded_batches
from cadenza.llm.tokens import WordMemo, in_chunks, vocabulary

SPACE = "▁"
NO_RANK = np.iinfo(np.int32).max


class PieceCounter:
    """Counts the tokens of a sentencepiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for probe in ("a  b ", "ﬁ Ａ"):
            if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
                raise ValueError(f"{path}: only models without normalisation are supported")
        scores = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                scores[model.id_to_piece(i)] = model.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in scores):
            raise ValueError(f"{path}: pieces that cross words are not supported")
        symbols = {p: k for k, p in enumerate(scores)}
        for p in scores:
            for c in p:
                symbols.setdefault(c, len(symbols))
        self.symbols = symbols
        self.width = np.array([1 if s in scores else len(s.encode()) for s in symbols], np.int32)
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for p, score in scores.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (order[score], symbols[p])
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.rank = np.array([pairs[int(k)][0] for k in keys] + [NO_RANK], np.int32)
        self.merged = np.array([pairs[int(k)][1] for k in keys] + [-1], np.int32)
        breaks = "\n" if not any("\n" in p for p in scores) else ""
        self.words = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if breaks else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.memo = WordMemo(self.count_words)

    def split(self, text: str) -> list[str]:
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def count_words(self, words: list[str]) -> list[int]:
        return [n for part in in_chunks(words, len, 1_000_000) for n in self._merge(part)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        at = np.where(hit, at, len(self.keys) - 1)
        return self.rank[at], self.merged[at]

    def _merge(self, words: list[str]) -> list[int]:
        get = self.symbols.get
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = "".join(words)
        sym = np.fromiter((get(c, -1) for c in flat), np.int32, len(flat))
        total = np.zeros(len(words), np.int64)
        for k in np.flatnonzero(sym < 0).tolist():  # unknown characters count as their bytes, less the one counted below
            sym[k] = -1 - len(flat[k].encode())
        row = np.repeat(np.arange(len(words)), lengths)
        while len(row):
            rank = np.full(len(row), NO_RANK, np.int32)
            into = np.full(len(row), -1, np.int32)
            joined = np.flatnonzero(row[:-1] == row[1:])
            rank[joined], into[joined] = self._ranks(sym[joined], sym[joined + 1])
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            sizes = np.diff(np.r_[starts, len(row)])
            lowest = np.minimum.reduceat(rank, starts)
            done = np.repeat(lowest == NO_RANK, sizes)
            if done.any():
                ended = sym[done]
                width = np.where(ended < 0, -1 - ended, self.width[np.maximum(ended, 0)])
                total += np.bincount(row[done], weights=width, minlength=len(words)).astype(np.int64)
            at = np.flatnonzero((rank == np.repeat(lowest, sizes)) & ~done)
            at = at[np.r_[True, row[at][1:] != row[at][:-1]]] if len(at) else at  # the leftmost of each pre-token
            sym[at] = into[at]
            keep = ~done
            keep[at + 1] = False
            sym, row = sym[keep], row[keep]
        return total.tolist()

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for part in in_chunks(texts, len):
            split = [self.split(t) for t in part]
            self.memo.learn(w for words in split for w in words)
            size = self.memo.__getitem__
            out += [sum(map(size, words)) for words in split]
        return out


@functools.cache
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Bytes and tokens of every text: ``id_col``, n_bytes, n_tokens (long), over_limit (n_tokens > ``limit``).

    A null or empty text has no bytes and no tokens. Ids may be null or repeat: one row comes out for each row in. Other
    columns are not read. An empty table gives an empty result. Texts are processed whole, whatever their length.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(vocabulary(model))
        for pdf in batches:
            texts = pdf["text"].tolist()
            n = c.count(texts)
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInPandas(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
