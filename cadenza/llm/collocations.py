"""Phrase collocation mining by stripes (operator 13).

A stripe belongs to a prefix of words and is an associative counter of the words that follow it. Tasks gather the stripes of
the text they hold, whole stripes are sent, and equal ones are merged elementwise. The stripe of the empty prefix counts words,
those of one word the pairs, and so on. The merged stripes give everything: an entry is an extension of its prefix, the
count of a prefix is its entry in the next shorter stripe, and the largest entries that extend a phrase to the right or left
tell whether a longer phrase subsumes it.

A stripe can be as wide as the language, so it isn't held in one place: a prefix with more than one in SHARES of all
occurrences has its stripe split by the hash of the next word, and merging is hash aggregation.

Lengths are counted one after another, as a phrase can't be more frequent than its parts. The frequent phrases of a length are
marked in a bit set of fixed size, and longer phrases with an unmarked part are not counted. Where the bit set is crowded, more is
counted than needed, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.joins import digest, looked_up
from cadenza.llm.lineage import bounded_batches, written

#: Bytes of text whose stripes a task gathers before it sends them.
WINDOW = 12_000_000
#: A prefix with more than one in this many of all occurrences has its stripe split; there are fewer such prefixes.
SHARES = 4096
#: Bits of the set of frequent phrases.
BITS = 1 << 26
NO_LANGUAGE = "und"
#: Bytes or words that are looked at together.
_BLOCK = 1 << 20
#: Cells of 64 bits that the driver gets in one row.
_SLICE = 1 << 13

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_END, _NEWLINE = b".,;:!?\n\v\f\r", 10
#: Lower case for A-Z, and one character for all that end a piece.
_PLAIN = bytes(10 if b in _END else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _then(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their prefixes and of their last words."""
    h = (h ^ (h >> np.uint64(31))) * _ODD + word
    return (h ^ (h >> np.uint64(29))) * _MIX


def _hashes(words: Iterable) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _phrase_hashes(lang: list, phrase: list) -> np.ndarray:
    """The hashes of phrases of equally many words, given by language and space-joined words."""
    h = _hashes(lang)
    for words in zip(*[p.split(" ") for p in phrase], strict=True):
        h = _then(h, _hashes(words))
    return h


def _pieces(lang: str, text: bytes, window: int) -> Iterator[tuple[str, bytes]]:
    """The plain text; a text longer than a window is cut between pieces."""
    text = text.translate(_PLAIN)
    at = 0
    while len(text) - at > window and (cut := text.find(b"\n", at + window)) >= 0:
        yield lang, text[at:cut]
        at = cut
    yield lang, text[at:]


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[list, list]]:
    """Languages and plain texts, about ``window`` bytes at a time."""
    langs, texts, size = [], [], 0
    for batch in batches:
        for k in range(len(batch)):  # one by one, so that no batch is held twice
            for lang, text in _pieces(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), window):
                langs.append(lang)
                texts.append(text)
                size += len(text) + 1
                if size >= window:
                    yield langs, texts
                    langs, texts, size = [], [], 0
    if texts:
        yield langs, texts


def _words(codes: np.ndarray, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of each word the language's code, the number of its piece and its number in the array of distinct words, which comes last.

    Bytes are looked at in blocks; of the whole window only words are held. Emptied, ``texts`` gives its memory back.
    """
    lang, piece, found, pieces, k = [], [], [], 0, 0
    while k < len(texts):
        first, size = k, 0
        while k < len(texts) and (k == first or size + len(texts[k]) < _BLOCK):
            size += len(texts[k])
            k += 1
        begins = np.cumsum([0, *[len(x) + 1 for x in texts[first : k - 1]]])
        raw = np.frombuffer(b"\n".join(texts[first:k]), np.uint8)
        texts[first:k] = [b""] * (k - first)
        ends = raw == _NEWLINE
        inside = ~(ends | (raw == 32) | (raw == 9))
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, stops = edge[::2], edge[1::2]
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(stops - starts, out=offsets[1:])
        found.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]))
        lang.append(codes[first + np.searchsorted(begins, starts, side="right") - 1].astype(np.int32))
        piece.append((np.searchsorted(np.flatnonzero(ends), starts) + pieces).astype(np.int32))
        pieces += int(ends.sum()) + 1
    encoded = pa.chunked_array(found, pa.binary()).dictionary_encode().unify_dictionaries()
    word = np.concatenate([np.empty(0, np.int32), *[c.indices.to_numpy() for c in encoded.chunks]])
    return np.concatenate(lang), np.concatenate(piece), word, encoded.chunk(0).dictionary if encoded.num_chunks else pa.array([], pa.binary())


class Frequent:
    """The frequent phrases of one length, as a bit set, and into how many parts the stripes of the most frequent are split."""

    def __init__(self, bits: np.ndarray, hashes: np.ndarray, parts: np.ndarray):
        self.bits = bits
        order = np.argsort(hashes)
        self.hashes, self.split = hashes[order], parts[order]

    def marked(self, h: np.ndarray) -> np.ndarray:
        cell = h % np.uint64(64 * len(self.bits))
        return (self.bits[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) == 1

    def parts(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.split[at], 1)


_STRIPE = "lang string, prefix string, part int, next array<string>, n array<long>"


def stripes(batches: Iterator[pa.RecordBatch], length: int, known: Frequent | None, window: int) -> Iterator[pa.RecordBatch]:
    """The stripes of prefixes of ``length - 1`` words in batches of (lang, text), window by window.

    ``known`` are the frequent phrases of ``length - 1`` words; without them nothing is left out. Words are told apart
    exactly, by Arrow's dictionaries; hashes serve the bit set and the splitting alone.
    """
    for langs, texts in _windows(batches, window):
        codes, code = np.unique(np.array(langs, object), return_inverse=True)
        lang, piece, word, distinct = _words(code, texts)
        h_word, h_lang = _hashes(distinct.to_pylist()), _hashes(codes)

        def phrase(first: np.ndarray, lang=lang, word=word, h_word=h_word, h_lang=h_lang) -> np.ndarray:
            """The hashes of the phrases of ``length - 1`` words from these places on."""
            h = h_lang[lang[first]]
            for k in range(length - 1):
                h = _then(h, h_word[word[first + k]])
            return h

        places = []
        for s in range(0, max(0, len(word) - length + 1), _BLOCK):
            at = np.arange(s, min(s + _BLOCK, len(word) - length + 1))
            at = at[piece[at] == piece[at + length - 1]]
            if known is not None:
                at = at[known.marked(phrase(at))]
                at = at[known.marked(phrase(at + 1))]
            places.append(at.astype(np.int32))
        at = np.concatenate(places) if places else np.empty(0, np.int32)
        del places, piece
        if not len(at):
            continue
        prefix = lang[at].astype(np.int64)
        for k in range(length - 1):  # dense numbers of the prefixes
            prefix *= len(distinct)
            prefix += word[at + k]
            prefix = np.unique(prefix, return_inverse=True)[1]
        prefix *= len(distinct)
        prefix += word[at + length - 1]
        key, first, n = np.unique(prefix, return_index=True, return_counts=True)
        at = at[first]
        del prefix, first
        prefix, nxt = key // len(distinct), key % len(distinct)
        if known is None:
            split = np.full(len(at), SHARES if length == 1 else 1)
        else:
            split = np.concatenate([known.parts(phrase(at[s : s + _BLOCK])) for s in range(0, len(at), _BLOCK)])
        part = (h_word[nxt] >> np.uint64(20)).astype(np.int64) % split
        order = np.lexsort((part, prefix))
        prefix, part, nxt, at, n = prefix[order], part[order], nxt[order], at[order], n[order]
        stripe = np.flatnonzero(np.r_[True, (np.diff(prefix) != 0) | (np.diff(part) != 0)])
        offsets = pa.array(np.r_[stripe, len(n)].astype(np.int32))
        text_of, of = distinct.view(pa.string()), at[stripe]
        prefixes = [text_of.take(pa.array(word[of + k])) for k in range(length - 1)]
        columns = [
            pa.array(codes.tolist(), pa.string()).take(pa.array(lang[of])),
            pc.binary_join_element_wise(*prefixes, " ") if prefixes else pa.array([""] * len(of), pa.string()),
            pa.array(part[stripe].astype(np.int32)),
            pa.ListArray.from_arrays(offsets, text_of.take(pa.array(nxt))),
            pa.ListArray.from_arrays(offsets, pa.array(n)),
        ]
        sent = pa.RecordBatch.from_arrays(columns, names=["lang", "prefix", "part", "next", "n"])
        for s in range(0, len(sent), 1 << 15):
            yield sent.slice(s, 1 << 15)


def _merged(docs: DataFrame, length: int, known: Frequent | None, window: int) -> DataFrame:
    """(lang, prefix, phrase, n): the entries of all stripes of one length, each stripe merged elementwise."""
    sent = docs.mapInArrow(lambda batches: stripes(batches, length, known, window), _STRIPE)
    entries = sent.repartition("lang", "prefix", "part").select("lang", "prefix", "part", F.inline(F.arrays_zip("next", "n")))
    merged = entries.groupBy("lang", "prefix", "part", "next").agg(F.sum("n").alias("n"))
    phrase = F.col("next") if length == 1 else F.concat_ws(" ", "prefix", "next")
    return merged.select("lang", "prefix", phrase.alias("phrase"), "n")


def _frequent(phrases: DataFrame, total: int, n_bits: int, shares: int) -> Frequent:
    """Of the frequent phrases of one length; the driver gets ``n_bits`` bits and fewer than ``shares`` phrases."""

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = np.unique(_phrase_hashes(pdf["lang"].tolist(), pdf["phrase"].tolist()) % np.uint64(n_bits))
            at, first = np.unique(cell >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (cell & np.uint64(63)), first) if len(at) else cell
            yield pd.DataFrame({"at": at.astype(np.int64), "bits": bits.view(np.int64)})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, rows in pdf.groupby("slice"):
                slices.setdefault(k, np.zeros(_SLICE, np.int64))[rows["at"].to_numpy() % _SLICE] = rows["bits"].to_numpy()
        yield pd.DataFrame({"slice": list(slices), "bits": [x.tobytes() for x in slices.values()]})

    cells = phrases.select("lang", "phrase").mapInPandas(marks, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    sliced = cells.withColumn("slice", F.floor(F.col("at") / _SLICE)).repartition("slice").mapInPandas(packed, "slice long, bits binary")
    bits = np.zeros(-(-n_bits // (64 * _SLICE)) * _SLICE, np.int64)
    for row in sliced.collect():
        bits[row["slice"] * _SLICE : (row["slice"] + 1) * _SLICE] = np.frombuffer(row["bits"], np.int64)
    bits = bits[: n_bits >> 6]
    most = phrases.filter(F.col("n") * shares > total).select("lang", "phrase", "n").toPandas()
    parts = -(-most["n"].to_numpy(np.int64) * shares // max(total, 1))
    return Frequent(bits.view(np.uint64), _phrase_hashes(most["lang"].tolist(), most["phrase"].tolist()), parts)


def collocations(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 3,
    least: int = 10,
    subsumed: int = 50,
    top: int = 2000,
    window: int = WINDOW,
    bits: int = BITS,
    shares: int = SHARES,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``longest`` words of every language.

    Texts are lower-cased (A-Z), split into pieces at .,;:!? and the characters 10 to 13, and these into words at space and tab. A
    phrase occurs a times, at least ``least``, within pieces, overlaps included. Cut in two whose parts occur l and r times, it
    scores floor(1000000 a a / (l r)); of its cuts the one of the lowest score counts, then the one with the shortest first part.
    Phrases inside a longer one of at least ``least`` occurrences and ``subsumed`` per cent of theirs are dropped. Higher
    scores come first, then higher a, then phrases in the order of their bytes; n counts the words of the language.

    A null language counts as NO_LANGUAGE, a null text as empty; repeated rows count repeatedly; other columns are not read; an empty
    table gives an empty result. Arithmetic is exact, in 38 digits. ``window``, ``bits`` (a multiple of 64) and ``shares`` change no result.
    """
    bounded_batches(docs.sparkSession)
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    words = written(_merged(given, 1, None, window))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = sum(x["n"] for x in totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect())
    levels = [words.filter(F.col("n") >= least)]
    for length in range(2, longest + 1):
        levels.append(written(_merged(given, length, _frequent(levels[-1], total, bits, shares), window).filter(F.col("n") >= least)))
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.union(level)
    longer = None
    for level in levels[2:]:  # an extension by one word is at least as frequent as any longer one that holds the phrase
        suffix = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
        both = level.select("lang", F.explode(F.array("prefix", suffix)).alias("phrase"), F.col("n").alias("longer"))
        longer = both if longer is None else longer.union(both)
    candidates = counts.filter("prefix <> ''").select("lang", "phrase", F.col("n").alias("a"))
    if longer is not None:
        most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        candidates = candidates.join(most, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < subsumed * F.col("a"), F.lit(True))).drop("longer")
    parts = F.split("phrase", " ")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)))
    cuts = written(
        cut.select(
            "lang",
            "phrase",
            "a",
            "k",
            digest("lang", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ")).alias("left"),
            digest("lang", F.array_join(F.slice(parts, F.col("k") + 1, F.size(parts)), " ")).alias("right"),
        )
    )
    n_cuts, known, found = cuts.count(), counts.select(digest("lang", "phrase").alias("key"), F.col("n").alias("f")), cuts
    for side, name in (("left", "l"), ("right", "r")):
        used = cuts.groupBy(F.col(side).alias("key")).agg(F.count("*").alias("uses"))
        table = known.join(used, "key").select(F.col("key").alias(side), F.col("f").alias(name), "uses")
        found = looked_up(found, table, on=side, count="uses", total=n_cuts, values=[name], spread="phrase")
    a, l, r = (F.col(c).cast("decimal(19,0)") for c in "alr")
    scored = found.withColumns({"over": F.lit(1_000_000).cast("decimal(7,0)") * (a * a).cast("decimal(30,0)"), "under": (l * r).cast("decimal(38,0)")})
    lowest = F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("cut")
    ranked = scored.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = ranked.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB.
COLLOCATIONS_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
listed AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
places AS (SELECT lang, id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM listed),
grams AS (SELECT lang, x, lead(x) OVER p AS y, lead(x, 2) OVER p AS z FROM places WINDOW p AS (PARTITION BY id ORDER BY i)),
counts AS (SELECT lang, 1 AS size, x AS phrase, count(*) AS f FROM grams GROUP BY ALL
  UNION ALL SELECT lang, 2, x || ' ' || y, count(*) FROM grams WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM grams WHERE z IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, f AS a FROM counts WHERE size > 1 AND f >= 10),
longer AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM candidates WHERE size = 3
  UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM candidates WHERE size = 3) GROUP BY ALL),
cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, h.f AS l, t.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
  FROM cuts JOIN counts AS h ON h.lang = cuts.lang AND h.phrase = head JOIN counts AS t ON t.lang = cuts.lang AND t.phrase = rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
