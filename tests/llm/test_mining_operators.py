"""Hard negatives, quality rules and collocations, against plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np

from cadenza.llm import hard_negatives as hn
from cadenza.llm.collocations import collocations
from cadenza.llm.hard_negatives import hard_negatives
from cadenza.llm.repetition import COVERAGE, LINE_COVERAGE, covered, measures, quality_rules, repeated

VECTORS = "vec_id long, embedding array<double>, label int, score long, uid long, slot int"
DOCS = "doc_id long, text string, lang string, n long, phrase string, prefix string"


# Hard negatives


def plain_negatives(rows, is_anchor, n_positives=5, n_negatives=10, low=30, high=90):
    """The same by sorting everything; rows are (id, vector, label)."""
    fine = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for p, (i, q, c) in enumerate(fine):
        if i is None or not is_anchor(i):
            continue
        others = [(-sum(x * y for x, y in zip(q, w, strict=True)), math.inf if j is None else j, d == c) for n, (j, w, d) in enumerate(fine) if n != p and len(w) == len(q)]
        others.sort()
        for s, j, _ in [x for x in others if x[2]][:n_positives]:
            inside = [x for x in others if not x[2] and low * -s <= 100 * -x[0] <= high * -s][:n_negatives]
            out += [(i, None if j == math.inf else j, k + 1, None if m == math.inf else m, -s, -t) for k, (t, m, _) in enumerate(inside)]
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, v, c, 7, 8, 9) for i, v, c in rows], VECTORS)
    return sorted((tuple(r) for r in hard_negatives(df, anchor="vec_id % 10 = 0", **how).collect()), key=repr)


def test_negatives_are_those_of_a_full_sort(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 0.75], 4).tolist(), int(rng.integers(0, 3))) for i in range(240)]  # many ties
    rows += rows[:30]  # repeated rows, anchors among them
    expected = sorted(plain_negatives(rows, lambda i: i % 10 == 0), key=repr)
    assert len(expected) > 500 and found(spark, rows) == expected
    for name, value in (("ANCHORS", 7), ("ROWS", 16), ("_SCORES", 40)):  # many units, parts and steps
        monkeypatch.setattr(hn, name, value)
    assert found(spark, rows) == expected
    few = sorted(plain_negatives(rows, lambda i: i % 10 == 0, n_positives=2, n_negatives=3, low=0, high=100), key=repr)
    assert found(spark, rows, n_positives=2, n_negatives=3, low=0, high=100) == few


def test_negatives_of_odd_rows(spark):
    inf, nan = math.inf, math.nan
    good = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.25], 2), (None, [0.5, 0.25], 2), (10, [-1.0, 0.0], 1), (20, [], 1), (21, [], 1), (22, [], 2)]
    odd = [(30, None, 1), (40, [1.0, None], 1), (50, [nan, 1.0], 1), (60, [inf, 1.0], 1), (70, [1.0, 1.0], None), (3, [9.0, 9.0, 9.0], 2)]
    got = found(spark, good + odd)
    assert got == sorted(plain_negatives(good + odd, lambda i: i % 10 == 0), key=repr)
    assert (0, 1, 2, None, 81920, 40960) in got and (20, 21, 1, 22, 0, 0) in got
    assert found(spark, []) == [] and found(spark, [(1, [1.0], 1)]) == []


def test_scores_beyond_doubles_are_exact(spark):
    big = float(1 << 23)
    rows = [(0, [big, 1.0], 1), (1, [big / 2, 3.0], 1), (2, [big / 4, 1.0], 2), (3, [big / 4, 2.0], 2), (4, [1e300, 0.0], 1)]
    got = {r[:4]: r[4:] for r in found(spark, rows)}
    assert got[0, 1, 1, 3] == ((1 << 61) + 256 * 768, (1 << 60) + 256 * 512) and (0, 1, 2, 2) in got
    assert hn._dots(np.array([[1 << 62]]), np.array([[1 << 62], [-1 << 62]])).tolist() == [[(1 << 63) - 1, 1 - (1 << 63)]]


# Quality rules


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def inside(n, first):
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        times, seen, hit = Counter(grams), set(), set()
        for k, g in enumerate(grams):
            if times[g] > 1 and (first or g in seen):
                hit.update(range(k, k + n))
            seen.add(g)
        return hit

    lines, n_dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if chars := len(re.sub(r"[\x20\x09-\x0D]", "", line)):
            n_dup, dup_chars = n_dup + (line in lines), dup_chars + chars * (line in lines)
            lines.add(line)
    sums = [sum(len(words[k]) for k in inside(n, False)) for n in COVERAGE]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), n_dup, len(inside(8, True)), dup_chars, *sums]


def odd_texts():
    rng = random.Random(4)
    words = ["lorem", "ipsum", "é中", "a", "😀😀", "x#y", "<b>", "\xa0", "\x1c", " ", "\x00"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\t", "\n", "\r\n", "  ", "\x0b"]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    passage = " ".join(f"w{k}" for k in range(15))
    return texts + ["", " ", "\n\n", passage, f"{passage}\n{passage}", f"{passage}\n{passage} \n{passage}", "a " * 40, "a\n" * 40, " \n \n"]


def test_measures_are_those_of_plain_loops(monkeypatch):
    texts = odd_texts()
    expected = [plain_measures(t) for t in texts]
    assert [measures(t) for t in texts] == expected
    monkeypatch.setattr("cadenza.llm.repetition._PART", 7)  # words across the parts of long texts
    assert [measures(t) for t in texts] == expected


def test_repeats_and_coverage():
    places, again = repeated(np.array([5, 6, 5, 7, 5, 6], np.uint64))
    assert places.tolist() == [0, 1, 2, 4, 5] and again.tolist() == [False, False, True, True, True]
    assert covered(np.array([0, 1, 5]), 3, 9).tolist() == [True, True, True, True, False, True, True, True, False]
    assert not len(repeated(np.empty(0, np.uint64))[0])


def test_quality_rows(spark):
    prose = " ".join(f"word{k}" for k in range(300))
    kept_line, bad_line = f"{prose}\nsame line here\nsame line here", "\n".join(["one two three", *(f"x{k} y{k}" for k in range(18))] + ["one two three"] * 5)
    passage = prose + " " + " ".join(f"word{k}" for k in range(30))
    rows = [(1, prose), (1, prose), (2, kept_line), (3, bad_line), (4, passage), (5, "too few words"), (6, "again and again " * 30), (None, prose), (7, None), (8, ""), (9, "long " + prose * 400)]
    got = quality_rules(spark.createDataFrame([(i, t, "en", 1, "x", "y") for i, t in rows], DOCS)).collect()
    verdicts = sorted(((r["doc_id"], r["base_failed"], r["kept"]) for r in got), key=repr)
    assert verdicts == sorted(
        [(1, False, True), (1, False, True), (2, False, True), (3, False, False), (4, False, True), (5, True, False), (6, True, False), (None, False, True), (7, True, False), (8, True, False), (9, True, False)], key=repr
    )
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        assert list(r)[1:-2] == plain_measures(text)
    three = next(r for r in got if r["doc_id"] == 3)
    assert 100 * three["dup_line_chars"] > LINE_COVERAGE * three["word_chars"]
    assert quality_rules(spark.createDataFrame([], DOCS)).collect() == []


# Collocations


def plain_collocations(rows, longest=3, least=10, subsumed=50, top=2000):
    f = {}
    for lang, text in rows:
        counts = f.setdefault("und" if lang is None else lang, Counter())
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                counts.update(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        n = sum(v for k, v in counts.items() if len(k) == 1)
        candidates = {k: a for k, a in counts.items() if len(k) > 1 and a >= least}
        gone = {k[s : s + m] for k, a in candidates.items() for m in range(2, len(k)) for s in range(len(k) - m + 1) if 100 * a >= subsumed * counts[k[s : s + m]]}
        scored = []
        for k, a in candidates.items():
            if k not in gone:
                score, cut = min((10**6 * a * a // (counts[k[:c]] * counts[k[c:]]), c) for c in range(1, len(k)))
                scored.append((-score, -a, " ".join(k).encode(), counts[k[:cut]], counts[k[cut:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(k, t, lang, 1, "clash", "clash") for k, (lang, t) in enumerate(rows)], DOCS).repartition(3)
    return sorted(tuple(r) for r in collocations(df, **how).collect())


def phrases(rng, n):
    words = ["the", "The", "of", "new", "york", "times", "é", "É", "ab#c", "\xa0x", "😀", "z\x00"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\x0b", " "]) for _ in range(n))


def test_collocations_are_those_of_plain_counters(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["en", "en", "de", None, "und", ""]), phrases(rng, rng.randint(0, 300))) for _ in range(60)]
    rows += rows[:5] + [("en", None), (None, ""), ("xx", "once only"), ("en", "new york times " * 400), ("en", "a\x1cb " * 30)]
    expected = plain_collocations(rows)
    assert len(expected) > 100 and mined(spark, rows) == expected
    small = {"longest": 4, "least": 3, "subsumed": 30, "top": 25}
    assert mined(spark, rows, **small) == plain_collocations(rows, **small)
    # many windows, texts cut between pieces, a crowded bit set, other words with split stripes
    assert mined(spark, rows, window=200, bits=64, shares=50) == expected


def test_no_collocations(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", None), (None, "a b c"), ("en", "... \n")]) == []


def test_held_results_are_given_back():
    from cadenza.llm.tokens import held, release

    made = []

    @held
    def make(name):
        made.append(name)
        return object()

    first = make("a")
    assert make("a") is first and made == ["a"]
    release()
    assert make("a") is not first and made == ["a", "a"]
