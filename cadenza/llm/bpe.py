"""Byte-level BPE by speculation and verification (operator 6).

For each distinct pre-token the longest matches from the left are proposed. A sequence of tokens is what BPE gives if and
only if every token and every adjacent pair is what BPE gives for its own bytes, so all adjacent pairs of a batch are
checked at once in numpy: the merges that built the two neighbours are undone from the latest on, and a pair fails as soon
as a merge across the boundary would have come before the merge undone. Only pre-tokens with a failing pair are merged
exactly.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.lineage import bounded_batches
from cadenza.llm.tokens import WordMemo, in_chunks, vocabulary

#: The pre-token pattern of byte-level BPE vocabularies, with white space as Unicode defines it.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NEVER = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class SpeculativeBpe:
    """Encodes and decodes with a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.ids = {raw(t): i for t, i in vocab.items()}
        size = max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, i in self.ids.items():
            self.bytes[i] = t
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PRE_TOKENS)
        self.longest = max(map(len, self.ids))
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.made = np.full(size, -1, np.int64)  # rank of the merge that makes a token
        self.left, self.right = np.arange(size), np.arange(size)
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((x, y), (rank, z))
            if self.made[z] < 0:
                self.made[z], self.left[z], self.right[z] = rank, x, y
        keys = sorted(x << 32 | y for x, y in self.merge)
        self.keys = np.array([*keys, NEVER], np.int64)
        self.ranks = np.array([self.merge[k >> 32, k & 0xFFFFFFFF][0] for k in keys] + [NEVER], np.int64)
        reachable = [self.exact(t) == [i] if t and i not in self.special.values() else True for i, t in enumerate(self.bytes)]
        self.greedy = {t: i for t, i in self.ids.items() if reachable[i]}
        self.exactly_merged = 0
        self.memo = WordMemo(self.encode_words)

    def exact(self, word: bytes) -> list[int]:
        """Plain BPE: the earliest merge first, the leftmost of equals."""
        out = [self.ids[word[k : k + 1]] for k in range(len(word))]
        merge = self.merge.get
        none = (NEVER, 0)
        found = [merge(pair, none) for pair in zip(out, out[1:], strict=False)]
        while found and (best := min(found)) is not none and best[0] != NEVER:
            k = found.index(best)
            out[k : k + 2] = [best[1]]
            del found[k]
            if k:
                found[k - 1] = merge((out[k - 1], out[k]), none)
            if k < len(found):
                found[k] = merge((out[k], out[k + 1]), none)
        return out

    def propose(self, word: bytes) -> list[int]:
        whole = self.greedy.get(word)
        if whole is not None:
            return [whole]
        out, k, get = [], 0, self.greedy.get
        while k < len(word):
            for end in range(min(len(word), k + self.longest), k, -1):
                token = get(word[k:end])
                if token is not None:
                    break
            out.append(token)
            k = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbours, whether no merge across their boundary would have come first."""
        ok = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NEVER, np.int64)
        while len(open_):
            key = a << 32 | b
            at = np.searchsorted(self.keys, key)
            across = np.where(self.keys[at] == key, self.ranks[at], NEVER)
            bad = across < limit
            ok[open_[bad]] = False
            made_a, made_b = self.made[a], self.made[b]
            go = ~bad & ((made_a >= 0) | (made_b >= 0))
            undo_a = made_a > made_b  # of equal ranks the left one came first, so the right one is undone first
            limit = np.where(undo_a, made_a, made_b + 1)[go]
            a, b, open_ = np.where(undo_a, self.right[a], a)[go], np.where(undo_a, b, self.left[b])[go], open_[go]
        return ok

    def encode_words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(lengths.sum()))
        row = np.repeat(np.arange(len(words)), lengths)
        pairs = np.flatnonzero(row[:-1] == row[1:])
        failing = np.unique(row[pairs[~self.compatible(flat[pairs], flat[pairs + 1])]])
        self.exactly_merged += len(failing)
        for k in failing.tolist():
            proposed[k] = self.exact(raw[k])
        return [np.array(p, "<u4").tobytes() for p in proposed]

    def _parts(self, text: str) -> list[str | bytes]:
        if self.at_special is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        out: list[str | bytes] = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out += self.words.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        out = []
        for part in in_chunks(texts, len):
            split = [self._parts(t) for t in part]
            self.memo.learn(w for words in split for w in words if isinstance(w, str))
            get = self.memo.__getitem__
            out += [b"".join([get(w) if isinstance(w, str) else w for w in words]) for words in split]
        return out

    def decode(self, ids: bytes) -> str:
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", errors="replace")


@functools.cache
def codec(path: str) -> SpeculativeBpe:
    return SpeculativeBpe(path)


def encode_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = "byte_bpe_50k.json") -> DataFrame:
    """``id_col`` and ``ids``, the token ids of the whole text (array of long).

    A null or empty text has no ids. Ids may be null or repeat: one row comes out for each row in. Other columns are not
    read. Strings of special tokens inside a text become those tokens.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary(model))
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "ids": [np.frombuffer(x, "<u4").astype(np.int64) for x in c.encode(pdf["text"].tolist())]})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, ids array<bigint>").select(F.col("id").alias(id_col), "ids")


def round_trip_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = "byte_bpe_50k.json") -> DataFrame:
    """Encodes every whole text, decodes the ids, and returns ``id_col``, n_tokens, ids_sha256 and decoded_sha256.

    The same rules as ``encode_documents``; the decoded text of a null or empty text is empty.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary(model))
        for pdf in batches:
            ids = c.encode(pdf["text"].tolist())
            yield pd.DataFrame(
                {
                    "id": pdf["id"],
                    "n_tokens": [len(x) // 4 for x in ids],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids],
                }
            )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInPandas(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(F.col("id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")
