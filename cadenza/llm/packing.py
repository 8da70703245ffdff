"""Bounded-space online best-fit packing of token sequences (operator 9).

Every text becomes the ids of the tokenizers library and one end token; only longer documents are cut, into pieces of the
full length. Each partition packs its pieces as they come: a fixed number of bins is open, a bitset keyed by free space
finds the fullest bin that still takes a piece, and when all bins are taken the fullest closes first. What is still open
at a partition's end is packed once more, bin by bin, among neighbouring partitions, so many partitions cost little room.
"""

from __future__ import annotations

import itertools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.lineage import bounded_batches, written
from cadenza.llm.tokens import WordMemo, held, in_chunks, vocabulary

OPEN_BINS = 64
#: Pieces between white space are more than words.
MEMO_ENTRIES = 350_000
#: Python's str.split takes these for white space, Unicode's property doesn't.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPACE = regex.compile(r"\p{White_Space}+")
#: Partitions whose open bins are packed together; their bins are at most this many times OPEN_BINS.
NEIGHBOURS = 256


class WordEncoder:
    """Ids of whole texts by a word-wise vocabulary of the tokenizers library, each distinct piece between white space encoded once.

    The file's own normaliser and pattern decide what a word is; both are read from it and refused if unknown. No word of
    the pattern holds white space, so pieces between white space are encoded apart. Pieces reach the library in lower case
    and cut into words; the last token of a word carries the suffix of word ends, which tells where a word's ids end.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, mapped = spec["pre_tokenizer"]["pretokenizers"]
        known = (split["type"], split["behavior"], split["invert"]) == ("Split", "Removed", True) and not mapped["use_regex"] and spec["model"]["end_of_word_suffix"]
        if steps != ["NFC", "Replace", "Lowercase"] or not known:
            raise ValueError(f"{path}: its normaliser or pre-tokeniser is not supported")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.special = [a["content"] for a in spec["added_tokens"]]
        suffix, vocab = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[k for token, k in vocab.items() if token.endswith(suffix)]] = True
        self.of_words = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": mapped, "added_tokens": [], "post_processor": None}))
        self.assigned: set[str] = set()
        self.memo = WordMemo(self._encode_pieces, MEMO_ENTRIES)

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids; a piece is normalised and holds no white space."""
        found = [self.words.findall(p) for p in pieces]
        out: list[bytes] = []
        for part in in_chunks(found, len, 100_000):
            flat = [w for words in part for w in words]
            ids = np.array(self.of_words.encode_batch_fast([flat], is_pretokenized=True, add_special_tokens=False)[0].ids if flat else [], "<u4")
            after = np.r_[0, np.flatnonzero(self.ends_word[ids]) + 1]  # where each word's ids end
            at = (4 * after[np.cumsum([0, *map(len, part)])]).tolist()
            raw = ids.tobytes()
            out += [raw[s:e] for s, e in zip(at, at[1:], strict=False)]
        return out

    def _pieces(self, text: str) -> list[str] | None:
        """Normalised pieces of a text; None if the library has to take it whole: for special tokens, characters younger than
        Python's tables, which others class otherwise, and texts that aren't normalised, as tables of marks differ too."""
        if any(s in text for s in self.special):
            return None
        if not text.isascii():
            new = set(text).difference(self.assigned)
            if any(unicodedata.category(c) == "Cn" for c in new) or not unicodedata.is_normalized("NFC", text):
                return None
            self.assigned |= new
            text = text.replace("Σ", "σ")
        text = text.lower()
        return _SPACE.split(text) if any(c in text for c in _SEPARATORS) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        out = []
        for part in in_chunks(texts, len):
            split = [self._pieces(t) for t in part]
            self.memo.learn(itertools.chain.from_iterable(filter(None, split)))
            get = self.memo.__getitem__
            for text, pieces in zip(part, split, strict=True):
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if pieces is None else b"".join(map(get, pieces)))
        return out


@held
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class BestFit:
    """At most ``open_bins`` open bins; bit f of ``self.free`` is set while a bin with f free places is open."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.free = 0
        self.bins: dict[int, list[int]] = {}
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        bin_ = stack.pop()
        if not stack:
            del self.bins[free]
            self.free &= ~(1 << free)
        self.n_open -= 1
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        """The bin that takes a piece, and the piece's offset in it."""
        fitting = self.free >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1  # the fullest bin with room
            bin_ = self._take(free)
        else:
            if self.n_open >= self.open_bins and length < self.size:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes first
            bin_, free = self.n_bins, self.size
            self.n_bins += 1
        left = free - length
        if left:
            self.bins.setdefault(left, []).append(bin_)
            self.free |= 1 << left
            self.n_open += 1
        return bin_, self.size - free

    def still_open(self) -> dict[int, int]:
        """Free places of each open bin."""
        return {b: free for free, stack in self.bins.items() for b in stack}


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4096,
    end_id: int = 1,
    model: str = "word_bpe_49k.json",
    open_bins: int = OPEN_BINS,
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset, and with ``with_ids`` also
    ids (the piece's ids as little-endian unsigned 32-bit integers).

    A null or empty text is its end token alone. Documents of more than ``size`` tokens are cut into pieces of ``size``, the
    last may be shorter. In a sequence the pieces' offsets follow each other from 0 without gaps. Ids may be null or repeat:
    every row is packed as a document of its own. Other columns are not read; an empty table gives no pieces. The pieces
    are written once to the shared checkpoint folder, so that a lost executor can't deal them out anew.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(vocabulary(model))
        fit = BestFit(size, open_bins)
        end = np.array([end_id], "<u4").tobytes()
        columns = ["id", "piece", "start", "length", "ids_crc32", "bin", "offset", "ids"]
        for pdf in batches:
            rows = []
            for key, ids in zip(pdf["id"].tolist(), e.encode(pdf["text"].tolist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    bin_, offset = fit.put(len(part) // 4)
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part), bin_, offset, part if with_ids else None))
            yield pd.DataFrame(rows, columns=columns).assign(fill=None)
        left = [(None, -1, 0, 0, 0, b, 0, None, size - free) for b, free in sorted(fit.still_open().items())]
        yield pd.DataFrame(left, columns=[*columns, "fill"])  # the open bins follow as rows of their own

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, bin long, offset long, ids binary, fill long"
    packed = written(rows.mapInPandas(run, schema).withColumn("part", F.spark_partition_id()))
    open_bins_left = packed.filter("piece = -1").select((F.col("part") / NEIGHBOURS).cast("int").alias("near"), "part", "bin", "fill")
    moved = open_bins_left.groupBy("near").applyInPandas(_pack_open_bins(size), "part int, bin long, into long, shift long")
    pieces = packed.filter("piece >= 0").join(moved, ["part", "bin"], "left")
    own = F.lit(1 << 61) + F.shiftleft(F.col("part").cast("long"), 32) + F.col("bin")
    out = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.coalesce("into", own).alias("sequence_id")]
    return pieces.select(*out, (F.col("offset") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset"), *["ids"] * with_ids)


def _pack_open_bins(size: int):
    """Packs what open bins hold, the largest first; a group has at most NEIGHBOURS x open bins rows."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        fit = BestFit(size, len(pdf) + 1)
        pdf = pdf.sort_values(["fill", "part", "bin"], ascending=[False, True, True])
        got = [fit.put(n) for n in pdf["fill"].tolist()]
        return pd.DataFrame({"part": pdf["part"].to_numpy(), "bin": pdf["bin"].to_numpy(), "into": [int(key[0]) << 32 | b for b, _ in got], "shift": [s for _, s in got]})

    return run
