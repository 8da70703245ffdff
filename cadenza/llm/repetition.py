"""Quality rules by repetition coverage (operator 12).

Rolling hashes of several n-gram lengths, computed in numpy over a text's word hashes, show which n-grams occur again.
What counts is not how many there are but how many characters of the text lie inside them, each character once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from cadenza.llm.lineage import bounded_batches

#: For each n-gram length the percentage of a text's characters that repeated n-grams may cover (fixed values, as published
#: for web text), and the same for repeated lines.
COVERAGE = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_COVERAGE = 20
#: The plain rules: fewest words, length of the windows, and the percentage of words that repeated windows may hold.
LEAST_WORDS, WINDOW, WINDOW_SHARE = 20, 8, 30
SYMBOLS = "#*$%&|<>"

_SEPARATORS = " \t\n\v\f\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_LINE = re.compile(r"[^\n]+")
#: Characters that are split into words at once.
_PART = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"dup_chars_{n}" for n in COVERAGE]]


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the length in characters of each word of the text, which is split part by part."""
    hashes, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + _PART)
        end = cut.start() if cut else len(text)
        words = _WORD.findall(text, at, end)
        hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
        lengths.append(np.fromiter(map(len, words), np.int64, len(words)))
        at = end
    return np.concatenate(hashes).view(np.uint64), np.concatenate(lengths)


def _rolled(grams: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams from those of the (n - 1)-grams and the words."""
    h = (grams[:-1] ^ (grams[:-1] >> np.uint64(31))) * _ODD + words[n - 1 :]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def repeated(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all n-grams that occur twice or more, and which of them aren't the first of their kind."""
    s = np.sort(grams)
    several = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(several):
        return np.empty(0, np.int64), np.empty(0, bool)
    slot = np.minimum(np.searchsorted(several, grams), len(several) - 1)
    places = np.flatnonzero(several[slot] == grams)
    again = np.ones(len(places), bool)
    again[np.unique(slot[places], return_index=True)[1]] = False
    return places, again


def covered(places: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie inside an n-gram that starts at one of ``places``."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, places, 1)
    np.add.at(step, places + n, -1)
    return np.cumsum(step[:-1]) > 0


def measures(text: str) -> list[int]:
    """The counts named in _COUNTS, of one whole text."""
    words, lengths = _words(text)
    n_dup_lines = dup_line_chars = 0
    seen = set()
    for found in _LINE.finditer(text):
        line = found[0]
        if line in seen:
            n_dup_lines += 1
            dup_line_chars += len(line) - sum(map(line.count, _SEPARATORS))
        elif _WORD.search(line):
            seen.add(line)
    inside, n_repeat_words = dict.fromkeys(COVERAGE, 0), 0
    grams = words
    for n in range(2, max(*COVERAGE, WINDOW) + 1):
        if len(words) < n:
            break
        grams = _rolled(grams, words, n)
        if n in COVERAGE or n == WINDOW:
            places, again = repeated(grams)
            if not len(places):
                break  # longer n-grams don't recur either
            if n == WINDOW:
                n_repeat_words = int(covered(places, n, len(words)).sum())
            if n in COVERAGE:
                inside[n] = int(lengths[covered(places[again], n, len(words))].sum())
    return [len(words), int(lengths.sum()), sum(map(text.count, SYMBOLS)), n_dup_lines, n_repeat_words, dup_line_chars, *inside.values()]


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the counts, base_failed and kept for every row.

    Words are runs of characters other than space and the characters 9 to 13; a null or empty text has none and fails the plain
    rules. n_dup_lines are lines with a word that equal an earlier line, n_repeat_words the words in windows of WINDOW words
    found twice or more, the first included. dup_line_chars and dup_chars_n are the characters of words in lines and n-grams that
    occurred before in the same text. base_failed says that a text has too few words or too many in repeated windows; kept, that it
    hasn't and that no repeated n-grams or lines cover more of its characters than COVERAGE and LINE_COVERAGE allow (a share
    exactly at the limit is kept). Rows are judged one by one: repeated rows and ids and null ids stay as they are, other
    columns are not read, and an empty table gives an empty result. Long texts are read whole.
    """
    bounded_batches(docs.sparkSession)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([measures(text or "") for text in batch.column(1).to_pylist()], np.int64).reshape(-1, len(_COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts.T.copy()]], names=[id_col, *_COUNTS])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = StructType([StructField(id_col, rows.schema[0].dataType), *[StructField(c, LongType()) for c in _COUNTS]])
    found = rows.mapInArrow(measured, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > WINDOW_SHARE * F.col("n_words"))
    repeats = [(f"dup_chars_{n}", most) for n, most in COVERAGE.items()] + [("dup_line_chars", LINE_COVERAGE)]
    low = ~failed
    for name, most in repeats:
        low = low & (100 * F.col(name) <= most * F.col("word_chars"))
    return found.withColumns({"base_failed": failed.cast(BooleanType()), "kept": low.cast(BooleanType())})


def _grams_sql() -> str:
    """For each n-gram length the places of n-grams and how many equal ones came before, by text."""
    each = []
    for n in COVERAGE:
        gram = ", ".join(["w", *[f"lead(w, {k}) OVER p" for k in range(1, n)]])
        each.append(f"SELECT row_id, i, {n} AS n, [{gram}] AS gram FROM words WINDOW p AS (PARTITION BY row_id ORDER BY i)")
    return " UNION ALL ".join(each)


#: The same rows in DuckDB.
QUALITY_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
listed AS (SELECT row_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs),
words AS (SELECT row_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM listed),
grams AS (SELECT row_id, i, n, gram, count(*) OVER (PARTITION BY row_id, n, gram) AS times, row_number() OVER (PARTITION BY row_id, n, gram ORDER BY i) AS nth
  FROM ({_grams_sql()}) WHERE gram[n] IS NOT NULL),
inside AS (SELECT DISTINCT row_id, n, nth > 1 AS again, i + unnest(range(n)) AS i FROM grams WHERE times > 1),
measured AS (SELECT row_id, {", ".join(f"sum(length(w)) FILTER (WHERE n = {n} AND again) AS dup_chars_{n}" for n in COVERAGE)}, count(DISTINCT i) FILTER (WHERE n = {WINDOW}) AS n_repeat_words
  FROM inside JOIN words USING (row_id, i) GROUP BY row_id),
lines AS (SELECT row_id, line, row_number() OVER (PARTITION BY row_id, line) AS nth FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
recurring AS (SELECT row_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS dup_line_chars FROM lines WHERE nth > 1 GROUP BY row_id),
counted AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
  {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ["n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"dup_chars_{n}" for n in COVERAGE]])}
  FROM docs JOIN listed USING (row_id) LEFT JOIN measured USING (row_id) LEFT JOIN recurring USING (row_id)),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {WINDOW_SHARE} * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {LINE_COVERAGE} * word_chars AND {" AND ".join(f"100 * dup_chars_{n} <= {most} * word_chars" for n, most in COVERAGE.items())} AS kept FROM judged
"""
