"""Operators on texts, against brute force and the tokenizer libraries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm import candidates
from cadenza.llm import hidden_markov as hm
from cadenza.llm import toxicity as tx
from cadenza.llm.bpe import codec, encode_documents, round_trip_digests
from cadenza.llm.line_dedup import drop_recurring_lines
from cadenza.llm.near_text import document_frequencies, near_duplicates, similarities
from cadenza.llm.packing import BestFit, encoder, pack
from cadenza.llm.shingles import CELLS, idf, shingles, weighted_samples, word_hashes
from cadenza.llm.token_counts import count_tokens, counter
from cadenza.llm.tokens import WordMemo, vocabulary

ODD = ["", " ", "\n", "a" * 3000, " " * 500, "x\n" * 200, "naïve café ÅNGSTRÖM", "é ﬁ Ａ 中文 😀", "it's we'll I'd", "<|endoftext|> a<|endoftext|>", "\x00\x1c\x85\xa0　", "ΑΣ Σ", "▁ ▁▁x", "1234 5,678.90", "A\tB\r\nC"]
DOCS = "doc_id long, text string, extra string, id string"


def random_texts(n=400):
    rng = random.Random(5)
    letters = "ab e▁  \n\thelowrd中文é́ﬁ<s>\x00😀1239_.\xa0　ZzÑß'stremvdI"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ODD


def docs(spark, texts, start=0):
    return spark.createDataFrame([(k + start, t, "x", "clash") for k, t in enumerate(texts)], DOCS)


def prose(rng, n, words=("lorem", "ipsum", "dolor", "sit", "amet", "tempor", "magna", "aliqua", "enim", "minim", "veniam", "quis", "nostrud", "ullamco", "laboris", "nisi")):
    return " ".join(rng.choice(words) + rng.choice("abcdefghij") for _ in range(n))


# Token counts


def test_counts_are_the_librarys():
    path = vocabulary("piece_bpe_32k.model")
    texts = random_texts()
    expected = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)]
    assert counter(path).count(texts) == expected
    assert counter(path).count(texts) == expected  # now from the memo


def test_full_memo_is_emptied():
    memo = WordMemo(lambda words: [len(w) for w in words], entries=3)
    for words in (["a", "bb"], ["ccc", "a"], ["dddd", "bb"], iter(["x", "yy", "zzz", "wwww"])):
        words = list(words)
        memo.learn(w for w in words)
        assert [memo[w] for w in words] == [len(w) for w in words]


def test_token_count_rows(spark):
    rows = [(1, "naïve text", None, "a"), (1, "naïve text", None, "a"), (None, None, None, None), (3, "", None, None), (4, "word " * 5000, None, None)]
    got = [tuple(r) for r in count_tokens(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str)[0][1] == 11 and (None, 0, 0, False) in got and (3, 0, 0, False) in got and len(got) == 5
    assert next(r for r in got if r[0] == 4)[3] is True
    assert count_tokens(spark.createDataFrame([], DOCS)).count() == 0


# Byte-level BPE


def test_ids_are_the_librarys():
    path = vocabulary("byte_bpe_50k.json")
    c, library, texts = codec(path), Tokenizer.from_file(path), random_texts()
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode(texts)] == expected
    assert [c.decode(x) for x in c.encode(texts)] == [library.decode(i, skip_special_tokens=False) for i in expected]


def test_speculation_is_verified():
    c = codec(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 12))).encode() for _ in range(1500)]
    kept = 0
    for w in words:
        p = np.array(c.propose(w))
        if c.compatible(p[:-1], p[1:]).all():
            kept += 1
            assert p.tolist() == c.exact(w)
        else:
            assert p.tolist() != c.exact(w)
    assert 0 < kept < len(words)


def test_bpe_rows(spark):
    rows = [(1, "Hello world", None, None), (1, "Hello world", None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    ids = {r["doc_id"]: r["ids"] for r in encode_documents(df).collect()}
    assert ids[1] == Tokenizer.from_file(vocabulary("byte_bpe_50k.json")).encode("Hello world").ids and ids[None] == []
    got = round_trip_digests(df).collect()
    assert len(got) == 3 and {r["n_tokens"] for r in got} == {0, 2}
    assert round_trip_digests(spark.createDataFrame([], DOCS)).count() == 0


# Packing


def test_word_ids_are_the_librarys():
    path = vocabulary("word_bpe_49k.json")
    library, texts = Tokenizer.from_file(path), random_texts()
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(path).encode(texts)] == expected


def test_word_ids_of_odd_characters():
    path = vocabulary("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(path), random.Random(13)
    marks = [chr(c) for c in (0x316, 0x307, 0x301, 0x327, 0x345, 0x130, 0x1E9E, 0x2028, 0x200B, 0xFB01, 0x1100, 0x1161, 0x2160, 0x187F8, 0x32000)]
    letters = [*"aAbB'stre 19_.\t\n\x1c\x1f\x85\xa0Σσςıß", *marks]
    texts = ["".join(rng.choice(letters) if rng.random() < 0.8 else chr(rng.randrange(0x80, 0xD800)) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["\u0130\u0316"] + [chr(c) + "a" for c in range(0x80, 0x3000)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(path).encode(texts)] == expected


def test_best_fit_takes_the_fullest_bin():
    fit = BestFit(10, 3)
    assert [fit.put(n)[0] for n in (6, 5, 7, 3, 4)] == [0, 1, 2, 2, 0]
    rng = random.Random(2)
    fit, fill = BestFit(100, 5), Counter()
    for _ in range(2000):
        n = rng.randint(1, 100)
        b, offset = fit.put(n)
        assert offset == fill[b]
        fill[b] += n
        assert fill[b] <= 100 and fit.n_open <= 5


def test_packing(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.choice([1, 30, 300, 900, 6000])) for _ in range(120)] + ["", None, "twice", "twice"]
    df = docs(spark, texts).repartition(5)
    rows = pack(df, size=1024).collect()
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(part) and bytes(r["ids"]) == part
    for k, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces))) and sum(p["length"] for p in pieces) == len(ids[k])
        assert all(p["length"] == 1024 for p in pieces[:-1])
    assert set(by_doc) == set(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    assert len(by_sequence) <= 1.05 * math.ceil(sum(map(len, ids.values())) / 1024) + 2
    assert pack(spark.createDataFrame([], DOCS), with_ids=False).count() == 0


# Shingles and near duplicates


def test_word_hashes():
    assert (word_hashes("It's A-b, c!") == word_hashes("it s\na b C")).all() and len(word_hashes("*** ##")) == 0
    long = word_hashes("alpha beta gamma " * 10_000)
    assert len(long) == 30_000 and set(long.tolist()) == set(word_hashes("gamma alpha beta").tolist())


def test_samples_agree_with_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        gap = []
        for _ in range(150):
            h = rng.integers(0, 1 << 63, 300).astype(np.uint64)
            w, x = rng.uniform(1, 6, 300), rng.random(300)
            a, b = x < (1 + share) / 2, x > (1 - share) / 2
            j = w[a & b].sum() / w.sum()
            gap.append((weighted_samples(h[a], w[a], 32) == weighted_samples(h[b], w[b], 32)).mean() - j)
        assert abs(np.mean(gap)) < 0.02


def near_copy(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = prose(rng, 1) + "z"
    return " ".join(words)


def classes_by_brute_force(texts, df, n, threshold=0.8):
    distinct = sorted({t or "" for t in texts})
    weight = idf(df, n)
    sets = [shingles(t) for t in distinct]
    label = list(range(len(distinct)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    bags = [dict(zip(h.tolist(), c.tolist(), strict=True)) for h, c in sets]
    for i in range(len(distinct)):
        for j in range(i):
            keys = bags[i].keys() | bags[j].keys()
            if bags[i].keys() & bags[j].keys():
                lo = sum(min(bags[i].get(k, 0), bags[j].get(k, 0)) * weight[k % CELLS] for k in keys)
                hi = sum(max(bags[i].get(k, 0), bags[j].get(k, 0)) * weight[k % CELLS] for k in keys)
                lo_plain = sum(min(bags[i].get(k, 0), bags[j].get(k, 0)) for k in keys)
                if lo / hi >= threshold or lo_plain / sum(max(bags[i].get(k, 0), bags[j].get(k, 0)) for k in keys) >= threshold:
                    label[find(i)] = find(j)
    place = {t: find(k) for k, t in enumerate(distinct)}
    first: dict = {}
    for k, t in enumerate(texts):
        first.setdefault(place[t or ""], k)
    return {k: k if not (t or "").strip() else first[place[t or ""]] for k, t in enumerate(texts)}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    base = [prose(rng, rng.choice([60, 150, 400])) for _ in range(25)]
    texts = base + [near_copy(rng, rng.choice(base), rng.choice([0, 1, 2, 4])) for _ in range(60)] + ["", "  ", None, "two words", "two words", "!!!", "!!!", "spam " * 500, "spam " * 501]
    df = docs(spark, texts)
    counts, n = document_frequencies(df.select(F.coalesce("text", F.lit("")).alias("text")))
    assert n == len(texts)
    expected = classes_by_brute_force(texts, counts, n)
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_duplicates(df).collect()}
    assert {k: c for k, (c, _) in got.items()} == expected
    assert all(kept == (k == c) for k, (c, kept) in got.items())


def test_near_copies_of_a_large_group_are_linked(spark):
    rng = random.Random(6)
    base = prose(rng, 204).split()
    texts = []
    for k in range(20):  # a third of the rows; every two have 180 of 220 shingles in common
        words = list(base)
        words[4 + 10 * k], words[9 + 10 * k] = f"one{k}", f"two{k}"
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, texts + [prose(rng, 204) for _ in range(40)])).collect()}
    assert got == {k: 0 if k < 20 else k for k in range(60)}


def test_wide_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(candidates, "BLOCK", 4)  # so that buckets of few nodes have many blocks
    rng = random.Random(9)
    words = prose(rng, 300).split()
    texts = []
    for k in range(90):  # a drifting chain: neighbours are alike, ends aren't, and few are linked with a bucket's lead
        texts.append(" ".join(words))
        words[(7 * k) % 300] = f"new{k}"
    texts += [texts[0], texts[40]] * 30 + [prose(rng, 80) for _ in range(30)] + ["long " * 200_000, "long " * 200_000]
    df = docs(spark, texts)
    counts, n = document_frequencies(df.select("text"))
    expected = classes_by_brute_force(texts, counts, n)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()} == expected


def test_loose_nodes_meet_their_whole_bucket(spark, monkeypatch):
    monkeypatch.setattr(candidates, "BLOCK", 3)
    node = [bytes([k]) * 16 for k in range(20)]
    members = spark.createDataFrame([(0, 5, x) for x in node] + [(1, 6, node[0]), (1, 6, node[1]), (2, 7, node[3])], "band int, key long, node binary")
    shared = candidates.shared_buckets(members, members.count())
    assert {(r["band"], r["n"]) for r in shared.collect()} == {(0, 20), (1, 2)}
    loose = spark.createDataFrame([(0, 5, x) for x in node[:5]], "band int, key long, node binary")
    met = set()
    units: dict = {}
    for r in candidates.loose_blocks(shared, loose, 23).collect():
        units.setdefault((r["band"], r["key"], r["i"], r["j"]), set()).add(bytes(r["node"]))
    for together in units.values():
        met |= {(a, b) for a in together for b in together}
    assert {(a, b) for a in node[:5] for b in node} <= met
    star: dict = {}
    for r in candidates.stars(shared).collect():
        star.setdefault((r["band"], r["i"]), []).append((bytes(r["node"]), r["lead"]))
    assert all(sum(lead for _, lead in rows) == 1 for rows in star.values())
    assert {n for (band, _), rows in star.items() for n, _ in rows if not band} == set(node)


def test_similarities_count_repeated_shingles():
    sets = [shingles("a b c d e a b c d e a b c d e"), shingles("a b c d e a b c d e"), shingles("q")]
    j = similarities(sets, np.ones(CELLS))
    assert j[0, 1] == pytest.approx(6 / 11) and j[0, 2] == 0


def test_near_duplicates_of_odd_tables(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(7, "same text here", None, None), (7, "same text here", None, None), (None, "same text here", None, None), (None, None, None, None)]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == [(7, 7, True), (7, 7, True), (None, 7, False), (None, None, True)]


# Lines


def test_line_dedup(spark):
    licence = "Copyright 2019 by the Example Company, all rights reserved"
    varied = "one two three four five six seven eight nine ten eleven twelve"
    texts = [
        f"first own line of this text\n{licence}\nTi.\nrepeated in one document only\nrepeated in one document only",
        f"second own line of this text\n{licence.replace('2019', '2021')}\nTi.",
        f"{varied}\nkeep  me   as I am, please\r\n",
        f"{varied.replace('five', 'CHANGED')}\nthird own line of another text",
        None,
        "",
        f"{licence}",
    ]
    got = {r["doc_id"]: r for r in drop_recurring_lines(docs(spark, texts)).collect()}
    assert got[0]["text"] == texts[0] and got[1]["text"] == "second own line of this text\nTi." and got[1]["n_dropped"] == 1
    assert got[2]["text"] == texts[2] and got[3]["text"] == "third own line of another text"
    assert (got[4]["text"], got[4]["n_lines"]) == (None, 0) and got[5]["text"] == "" and (got[6]["text"], got[6]["n_dropped"]) == ("", 1)
    assert got[0].asDict().keys() == {"doc_id", "text", "extra", "id", "n_lines", "n_dropped"}


def test_fields_at_any_two_places_are_generalised(spark):
    words = [f"w{chr(97 + k)}" for k in range(14)]
    texts = [" ".join(words)]
    for a, b in ((4, 7), (5, 8), (3, 13), (9, 10)):
        texts.append(" ".join("field" + chr(97 + a) if k in (a, b) else w for k, w in enumerate(words)))
    texts.append(" ".join(f"other{chr(97 + k)}" if k > 2 else w for k, w in enumerate(words)))
    got = {r["doc_id"]: r["n_dropped"] for r in drop_recurring_lines(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0}


def test_short_lines_need_more_documents(spark):
    texts = ["read all of it"] * 25 + ["read it"] * 60 + ["\r\n \n"] * 30 + ["in two documents only\n" + "alone " * 50_000] * 1 + ["in two documents only"]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in drop_recurring_lines(docs(spark, texts)).collect()}
    assert got[0] == ("read all of it", 0) and all(got[k] == ("", 1) for k in range(1, 25))  # four tokens: twenty documents
    assert all(got[k] == ("read it", 0) for k in range(25, 85)) and all(got[k] == ("\r\n \n", 0) for k in range(85, 115))
    assert got[115][1] == got[116][1] == 0


def test_line_dedup_of_odd_tables(spark):
    assert drop_recurring_lines(spark.createDataFrame([], DOCS)).count() == 0
    line = "a line of enough words to count"
    rows = [(1, line, None, None), (1, line, None, None), (None, line, None, None)]
    assert [r["text"] for r in drop_recurring_lines(spark.createDataFrame(rows, DOCS)).collect()] == [line] * 3
    clash = spark.createDataFrame([(1, line, 5)], "doc_id long, text string, n_lines int")
    assert drop_recurring_lines(clash).columns == ["doc_id", "text", "n_lines", "n_dropped"]


# Toxicity


def labelled(spark, n=260):
    rng = random.Random(6)
    texts, toxic = [], []
    for k in range(n):
        words = prose(rng, 80).split()
        toxic.append(int(k % 4 == 0))
        if toxic[-1]:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vilewordone", "vilewordtwo", "vilewordthree"]))
        texts.append(" ".join(words))
    labels = spark.createDataFrame([(k, 1, t) for k, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    return docs(spark, texts), labels, toxic


def test_toxicity_is_learnt(spark):
    df, labels, toxic = labelled(spark)
    got = {r["doc_id"]: r for r in tx.toxicity(df, labels).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 3 == 1]
    assert held == [k for k in got if got[k]["held_out"]] and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[k]["predicted"] == toxic[k] for k in held]) > 0.97
    clean = tx.drop_toxic(df, labels)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {k for k, r in got.items() if not r["predicted"]}


def test_toxicity_of_odd_tables(spark):
    df, labels, _ = labelled(spark, 80)
    odd = spark.createDataFrame([(None, None, None, None), (500, "", None, None), (501, "?!", None, None), (501, "?!", None, None), (502, "word " * 40_000, None, None)], DOCS)
    got = tx.toxicity(df.unionByName(odd), labels).filter("doc_id is null or doc_id >= 500").collect()
    assert len(got) == 5 and all(r["predicted"] == 0 for r in got)
    empty = labels.filter("false")
    assert {r["score"] for r in tx.toxicity(df, empty).collect()} == {0.5} and tx.drop_toxic(df, empty).count() == df.count()
    assert tx.toxicity(spark.createDataFrame([], DOCS), labels).count() == 0


# Language model


def test_base_model_against_brute_force(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(0, 60)).upper() for _ in range(150)] + ["", None, "ÄÖ unseenword\x0bA\x1cb", "x" * 300]
    got = {r["doc_id"]: r for r in hm.score(docs(spark, texts)).collect()}
    split = lambda t: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [None]
    counts: Counter = Counter()
    for k, t in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 7 != 2:
            counts.update(split(t))
    n, v = sum(counts.values()), len(counts)
    for k, t in enumerate(texts):
        words, r = split(t), got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 7 == 2) and r["score"] < 0


def paths(model, obs):
    import itertools

    return sum(
        model.start[p[0]] * model.emit[obs[0], p[0]] * np.prod([model.move[a, b] * model.emit[o, b] for a, b, o in zip(p, p[1:], obs[1:], strict=False)])
        for p in itertools.product(range(hm.STATES), repeat=len(obs))
    )


def random_model(rng, symbols):
    emit = rng.random((symbols, hm.STATES))
    move = rng.random((hm.STATES, hm.STATES))
    start = rng.random(hm.STATES)
    return hm.Markov(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_counts_of_windows_are_those_of_whole_texts():
    rng = np.random.default_rng(7)
    model = random_model(rng, 9)
    sequences = [rng.integers(0, 9, n) for n in (1, 40, 3, 17, 40, 5)]
    whole = hm.expected_counts(model, sequences, window=1000)
    assert whole[0].sum() == pytest.approx(6) and whole[1].sum() == pytest.approx(sum(map(len, sequences)) - 6) and whole[2].sum() == pytest.approx(sum(map(len, sequences)))
    for window in (1, 2, 7, 40):
        for a, b in zip(whole, hm.expected_counts(model, sequences, window=window), strict=True):
            assert a == pytest.approx(b)
    for k, s in enumerate(sequences[:4:3]):  # moves and states of one sequence, by its own forward and backward pass
        alone = hm.expected_counts(model, [s], window=4)
        alpha, beta = [model.start * model.emit[s[0]]], [np.ones(hm.STATES)]
        for o in s[1:]:
            alpha.append(alpha[-1] @ model.move * model.emit[o])
        for o in s[:0:-1]:
            beta.insert(0, model.move @ (model.emit[o] * beta[0]))
        total = alpha[-1].sum()
        moves = sum((np.outer(alpha[t], model.emit[s[t + 1]] * beta[t + 1]) * model.move / total for t in range(len(s) - 1)), np.zeros((hm.STATES, hm.STATES)))
        assert alone[1] == pytest.approx(moves) and alone[0] == pytest.approx(alpha[0] * beta[0] / total)


def test_blocks_hold_every_sequence():
    items = [np.zeros(n) for n in (5, 3000, 10, 2500, 7, 9000)]
    got = [len(s) for part in hm._blocks(iter([items[:3], items[3:]]), most=12) for s in part]
    assert sorted(got) == sorted(map(len, items))


def test_forward_is_exact():
    rng = np.random.default_rng(2)
    model = random_model(rng, 5)
    sequences = [rng.integers(0, 5, n) for n in (1, 4, 2, 4, 3)]
    assert hm.forward(model, sequences) == pytest.approx([math.log10(paths(model, s)) for s in sequences])


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(3)
    sequences = [np.tile(rng.integers(0, 3, 2) + 3 * (k % 2), 10) for k in range(20)]
    model, last = random_model(rng, 6), -np.inf
    for _ in range(6):
        first, moves, emitted, told = hm.expected_counts(model, sequences)
        assert told == pytest.approx(hm.forward(model, sequences).sum())
        assert first.sum() == pytest.approx(20) and emitted.sum() == pytest.approx(400) and moves.sum() == pytest.approx(380)
        model = hm.Markov(first / first.sum(), moves / moves.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=0))
        now = hm.forward(model, sequences).sum()
        assert now >= last - 1e-9
        last = now


def test_probabilities_sum_to_one(spark):
    rng = random.Random(3)
    df = docs(spark, [prose(rng, 50) for _ in range(40)]).select(F.col("doc_id").alias("id"), "text")
    v = hm.vocabulary_of(hm.count_words(df.select("text")))
    model = hm.train(df, v)
    assert model.emit.sum(axis=0) == pytest.approx(np.ones(hm.STATES)) and v.base.sum() == pytest.approx(1)
    shares = 10**v.share
    for c in set(v.symbol[v.own :].tolist()):  # shares of a class, and one for words not seen
        assert shares[v.symbol == c].sum() + 1 / v.class_total[c - v.own] == pytest.approx(1)


def test_model_of_odd_tables(spark):
    assert hm.score(spark.createDataFrame([], DOCS)).count() == 0
    got = hm.score(spark.createDataFrame([(None, None, None, None), (None, "a", None, None)], DOCS)).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 2] and not any(r["held_out"] for r in got)
