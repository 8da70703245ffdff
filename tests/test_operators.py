"""Each operator on small inline rows, against expected values or a plain restatement."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza import schemas
from cadenza.config import LABELS, Config
from cadenza.functions import expressions as fx
from cadenza.functions import signals
from cadenza.operators import align, boundaries, classify, export, overlap, planned, review, rules, runs, smooth

GRID = "video_id string, t int, is_speech int, rms_energy double, is_music int, hist_diff double, is_hard_cut int, scene array<double>, text_sim_to_next double, has_text int, text_sentence_id int"
SEG = "video_id string, segment_id int, start_sec double, end_sec double, label string, confidence double, visual_score double, audio_score double, text_score double, triggered_rules array<string>, summary string, user_corrected boolean"
TEXT = "video_id string, pos int, id int, start double, end double, text string, similarity_to_next double, matched_keywords array<string>"


def grid(spark, seconds, **columns):
    rows = []
    for t in range(seconds):
        row = {"is_speech": 0, "rms_energy": 0.0, "is_music": 0, "hist_diff": 0.0, "is_hard_cut": 0, "scene": [], "text_sim_to_next": None, "has_text": 0, "text_sentence_id": -1}
        row |= {k: v[t] for k, v in columns.items()}
        rows.append(("v", t, *row.values()))
    return spark.createDataFrame(rows, GRID)


def text(spark, rows):
    return spark.createDataFrame([("v", k, k, float(s), float(e), t, None, m) for k, (s, e, t, m) in enumerate(rows)], TEXT)


def spans(df):
    return sorted((r["start_sec"], r["end_sec"]) for r in df.collect())


def test_runs(spark):
    g = grid(spark, 7, is_speech=[0, 1, 1, 1, 0, 1, 1])
    assert spans(runs.runs(g, F.col("is_speech") == 1, 2)) == [(1, 4), (5, 7)]
    assert spans(runs.runs(g, F.col("is_speech") == 1, 2, gap=1)) == [(1, 7)]
    assert spans(runs.runs(g, F.col("is_speech") == 1, 7)) == []


def test_runs_with_gaps_against_loops(spark):
    rng = random.Random(1)
    rows, expected = [], set()
    for v in range(30):
        flags = [int(rng.random() < 0.7) for _ in range(60)]
        rows += [(str(v), t, f) for t, f in enumerate(flags)]
        filled = flags[:]
        on = [t for t, f in enumerate(flags) if f]
        for a, b in zip(on, on[1:], strict=False):
            if b - a - 1 <= 3:
                filled[a:b] = [1] * (b - a)
        start = None
        for t, f in enumerate([*filled, 0]):
            if f and start is None:
                start = t
            elif not f and start is not None:
                if t - start >= 15:
                    expected.add((str(v), start, t))
                start = None
    df = spark.createDataFrame(rows, "video_id string, t int, f int")
    assert {tuple(r) for r in runs.runs(df, F.col("f") == 1, 15, 3).collect()} == expected


def test_dead_air_is_strict(spark):
    assert rules.dead_air(grid(spark, 10, rms_energy=[0.01] * 10)).count() == 0
    assert spans(rules.dead_air(grid(spark, 10, rms_energy=[0.009] * 10))) == [(0, 10)]
    assert rules.dead_air(grid(spark, 10, rms_energy=[0.5] * 10)).count() == 0


def test_holding_and_ad_break(spark):
    g = grid(spark, 20, is_speech=[0] * 10 + [1] * 2 + [0] * 8, hist_diff=[0.05] * 10 + [0.0] * 10)
    assert spans(rules.holding_screen(g)) == [(12, 20)]
    assert spans(rules.ad_break(g)) == [(0, 20)]


def test_keyword_rules(spark):
    g = grid(spark, 120)
    t = text(spark, [(5, 8, "welcome back", ["intro:welcome back"]), (30, 32, "use code", ["sponsor:use code"]), (95, 99, "bye", ["outro:see you next time", "recap:to recap"])])
    assert spans(rules.sponsor_keywords(g, t)) == [(15, 47)]
    assert spans(rules.intro_keyword(g, t)) == [(0, 18)]
    assert spans(rules.outro_keyword(g, t)) == [(90, 120)]
    assert spans(rules.recap_keywords(g, t)) == [(90, 120)]
    hits = rules.all_rules(g, t).orderBy("hit_ord").collect()
    assert [h["label"] for h in hits] == ["dead_air", "holding_screen", "sponsorship", "recap", "intro", "outro", "sponsorship"]


def test_intro_stops_at_the_first_late_sentence(spark):
    g = grid(spark, 200)
    t = text(spark, [(100, 101, "late", []), (10, 12, "welcome back", ["intro:welcome back"])])
    assert rules.intro_keyword(g, t).count() == 0


def test_alignment(spark):
    durations = spark.createDataFrame([("v", 2.5), ("none", 0.0)], "video_id string, duration_sec double")
    spine = align.spine(durations)
    assert sorted(tuple(r) for r in spine.collect()) == [("v", 0), ("v", 1), ("v", 2)]
    audio = spark.createDataFrame(
        [("v", 0, 0.2, 1.0, True, 0.1, 1.0, 1.0, 0.1, 1.0, "speech"), ("v", 1, 0.9, 1.9, False, 0.3, 1.0, 1.0, 0.1, 1.0, "music"), ("v", 2, 9.0, 10.0, True, 0.1, 1.0, 1.0, 0.1, 1.0, "speech")],
        "video_id string, pos int, start double, end double, is_speech boolean, rms_energy double, spectral_centroid double, spectral_bandwidth double, zero_crossing_rate double, spectral_entropy double, audio_class string",
    )
    got = {r["t"]: (r["is_speech"], r["rms_energy"], r["is_music"]) for r in align.audio_grid(spine, audio).collect()}
    assert got == {0: (0, 0.3, 1), 1: (0, 0.0, 0), 2: (0, 0.0, 0)}
    t = spark.createDataFrame([("v", 0, 0, 0.5, 1.5, "a", 0.4, []), ("v", 1, 1, 1.2, 9.0, "b", None, []), ("v", 2, 2, 2.0, 2.0, "empty", 0.9, [])], TEXT)
    got = {r["t"]: (r["text_sentence_id"], r["text_sim_to_next"], r["has_text"]) for r in align.text_grid(spine, t).collect()}
    assert got == {0: (0, 0.4, 1), 1: (1, 0.4, 1), 2: (1, None, 1)}


def test_visual_grid(spark):
    spine = align.spine(spark.createDataFrame([("v", 3.0)], "video_id string, duration_sec double"))
    rows = [("v", 0, 0.0, 0.1, False, {"b": 0.7, "a": 0.3}), ("v", 1, 2.9, 0.9, True, {"a": 1.0, "c": 5.0})]
    visual = spark.createDataFrame(rows, "video_id string, pos int, timestamp_sec double, hist_diff_to_previous double, is_hard_cut boolean, clip_labels map<string,double>")
    labels = align.scene_labels(visual).first()["labels"]
    got = {r["t"]: (r["hist_diff"], r["is_hard_cut"], dict(zip(labels, r["scene"], strict=True))) for r in align.visual_grid(spine, visual).collect()}
    assert got == {0: (0.1, 0, {"a": 0.3, "b": 0.7}), 1: (0.0, 0, {"a": 0.0, "b": 0.0}), 2: (0.9, 1, {"a": 1.0, "b": 0.0})}


def test_divergence(spark):
    p, q = [0.7, 0.2, 0.1], [0.1, 0.2, 0.7]
    row = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    a, b = row.select(fx.scene_divergence(F.col("p"), F.col("q")), fx.scene_divergence(F.col("q"), F.col("p"))).first()
    assert a == pytest.approx(sum(0.5 * (x - y) * np.log(x / y) for x, y in zip(p, q, strict=True))) and a == pytest.approx(b)


def test_boundaries(spark):
    g = grid(spark, 20, is_speech=[0] * 10 + [1] * 10, is_hard_cut=[int(t in (5, 6)) for t in range(20)], text_sim_to_next=[0.1 if t == 14 else None for t in range(20)])
    c = boundaries.candidates(g)
    assert sorted(r["t"] for r in c.collect()) == [0, 5, 6, 10, 15, 20]
    assert boundaries.boundaries(c).first()["boundaries"] == [0, 5, 10, 15, 20]
    assert sorted(r["t"] for r in boundaries.flips(g, "is_speech").collect()) == [10]
    assert sorted(r["t"] for r in boundaries.hard_cuts(g).collect()) == [5, 6]


def test_boundaries_against_loops(spark):
    rng = random.Random(3)
    cases = {str(v): sorted({0, 40, *(rng.randrange(40) for _ in range(rng.randrange(15)))}) for v in range(60)}
    df = spark.createDataFrame([(v, t) for v, ts in cases.items() for t in ts], "video_id string, t int")
    for r in boundaries.boundaries(df).collect():
        kept = [0]
        for t in cases[r["video_id"]][1:]:
            if t - kept[-1] >= 3:
                kept.append(t)
        assert r["boundaries"] == (kept if kept[-1] == 40 else [*kept, 40])


def test_boundaries_of_very_long_recordings(spark):
    """A million candidates of one recording, all in one stretch, and as many at random; both take time in proportion."""
    dense = boundaries.boundaries(spark.range(1_000_000).selectExpr("'v' as video_id", "cast(id as int) as t")).first()["boundaries"]
    assert dense == list(range(0, 1_000_000, 3))
    times = np.unique(np.random.default_rng(2).integers(0, 2_000_000, 1_000_000))
    df = spark.createDataFrame(pd.DataFrame({"video_id": "v", "t": times.astype(np.int32)}))
    kept = [int(times[0])]
    for t in times[1:].tolist():
        if t - kept[-1] >= 3:
            kept.append(t)
    assert boundaries.boundaries(df).first()["boundaries"] == (kept if kept[-1] == times[-1] else [*kept, int(times[-1])])


@pytest.mark.parametrize("gap", [1, 2, 5])
def test_boundaries_with_other_gaps(spark, gap):
    times = [4, 5, 6, 8, 9, 13, 14, 15, 16, 17, 30]
    kept = [times[0]]
    kept += [t for t in times[1:] if t - kept[-1] >= gap and not kept.append(t)] and []
    if kept[-1] != times[-1]:
        kept.append(times[-1])
    df = spark.createDataFrame([("v", t) for t in times], "video_id string, t int")
    assert boundaries.boundaries(df, Config(min_gap=gap)).first()["boundaries"] == kept


def test_rule_coverage(spark):
    seg = spark.createDataFrame([("v", 0, 0, 10), ("v", 1, 10, 20)], "video_id string, segment_id int, start_sec int, end_sec int")
    hits = spark.createDataFrame(
        [("v", 1, 0, 2, "intro", "a", 0.9), ("v", 2, 0, 8, "recap", "b", 0.7), ("v", 3, 2, 10, "outro", "c", 0.7)],
        "video_id string, hit_ord int, start_sec int, end_sec int, label string, rule_name string, confidence double",
    )
    got = classify.rule_coverage(seg, hits).collect()
    assert [(r["segment_id"], r["label"], r["rules"]) for r in got] == [(0, "recap", ["b", "c"])]


def test_segments_skip_empty_intervals(spark):
    b = spark.createDataFrame([("v", [0, 5, 5, 10]), ("w", [0])], "video_id string, boundaries array<int>")
    assert sorted(tuple(r) for r in classify.segments(b).collect()) == [("v", 0, 0, 5), ("v", 2, 5, 10)]


def test_longest_sentence(spark):
    seg = spark.createDataFrame([("v", 0, 0, 10), ("v", 1, 10, 20), ("v", 2, 30, 40)], "video_id string, segment_id int, start_sec int, end_sec int")
    t = text(spark, [(0, 4, " four ", []), (4, 8, "longest", []), (8, 22, "overlapping text", [])])
    got = {r["segment_id"]: r["summary"] for r in classify.longest_sentence(seg, t).collect()}
    assert got == {0: "longest", 1: "overlapping text"}


def seg_rows(items):
    return [("v", k, float(s), float(e), label, c, 0.1, 0.2, 0.3, list(r), m, False) for k, (s, e, label, c, r, m) in enumerate(items)]


def as_tuples(df):
    return [(r["start_sec"], r["end_sec"], r["label"], r["confidence"], tuple(r["triggered_rules"]), r["summary"]) for r in df.orderBy("start_sec").collect()]


def test_merge_adjacent(spark):
    s = spark.createDataFrame(seg_rows([(0, 5, "intro", 0.5, ["b"], "x"), (5, 9, "intro", 0.7, ["a", "b"], "long"), (9, 12, "recap", 0.1, ["z", "z"], "")]), SEG)
    assert as_tuples(smooth.merge_adjacent(s)) == [(0, 9, "intro", 0.7, ("a", "b"), "long"), (9, 12, "recap", 0.1, ("z", "z"), "")]


def absorb_by_loops(segs):
    out = [list(s) for s in segs]
    while len(out) > 1:
        for i, s in enumerate(out):
            if s[1] - s[0] < 2:
                left, right = out[i - 1] if i else None, out[i + 1] if i + 1 < len(out) else None
                if right is None or (left is not None and left[3] >= right[3]):
                    left[1] = s[1]
                else:
                    right[0] = s[0]
                out.pop(i)
                break
        else:
            break
    return [tuple(s) for s in out]


def bridge_by_loops(segs):
    segs = [list(s) for s in segs]
    while True:
        out, i = [], 0
        while i < len(segs):
            if i + 2 < len(segs) and segs[i][2] == segs[i + 2][2] == "sponsorship" != segs[i + 1][2] and segs[i + 1][1] - segs[i + 1][0] <= 12:
                a, _, b = segs[i : i + 3]
                out.append([a[0], b[1], "sponsorship", min(a[3], b[3])])
                i += 3
            else:
                out.append(segs[i])
                i += 1
        if len(out) == len(segs):
            return [tuple(s) for s in out]
        segs = []
        for s in out:
            if segs and segs[-1][2] == s[2]:
                segs[-1][1], segs[-1][3] = s[1], max(segs[-1][3], s[3])
            else:
                segs.append(s)


def random_segments(rng, labels):
    t, out, last = 0.0, [], None
    for _ in range(rng.randrange(1, 12)):
        e = t + rng.choice([0.5, 1, 1.5, 2, 3, 8, 13])
        label = rng.choice([x for x in labels if x != last])
        out.append((t, e, label, rng.choice([0.2, 0.5, 0.5, 0.9])))
        t, last = e, label
    return out


@pytest.mark.parametrize("name", ["absorb", "bridge"])
def test_folds_against_loops(spark, name):
    rng = random.Random(7)
    cases = {str(v): random_segments(rng, ("sponsorship", "core_content", "intro")) for v in range(150)}
    rows = [(v, k, s, e, label, c, 0.0, 0.0, 0.0, [], "", False) for v, segs in cases.items() for k, (s, e, label, c) in enumerate(segs)]
    df = spark.createDataFrame(rows, SEG)
    got: dict = {}
    for r in (smooth.absorb_short if name == "absorb" else smooth.bridge)(df).orderBy("video_id", "start_sec").collect():
        got.setdefault(r["video_id"], []).append((r["start_sec"], r["end_sec"], r["label"], r["confidence"]))
    by_loops = absorb_by_loops if name == "absorb" else bridge_by_loops
    assert got == {v: by_loops(s) for v, s in cases.items()}


def test_bridge_adds_its_rule(spark):
    s = spark.createDataFrame(seg_rows([(0, 5, "sponsorship", 0.5, ["b"], "x"), (5, 9, "intro", 0.7, ["a"], ""), (9, 12, "sponsorship", 0.4, [], "")]), SEG)
    assert as_tuples(smooth.bridge(s)) == [(0, 12, "sponsorship", 0.4, ("a", "b", "sponsorship_bridge"), "x")]


def test_smoothing_keeps_the_span(spark):
    rng = random.Random(9)
    cases = {str(v): random_segments(rng, LABELS) for v in range(40)}
    rows = [(v, k, s, e, label, c, 0.0, 0.0, 0.0, [], "", False) for v, segs in cases.items() for k, (s, e, label, c) in enumerate(segs)]
    got: dict = {}
    for r in smooth.smooth(spark.createDataFrame(rows, SEG)).orderBy("video_id", "start_sec").collect():
        got.setdefault(r["video_id"], []).append(r)
    for v, segs in got.items():
        assert segs[0]["start_sec"] == 0 and segs[-1]["end_sec"] == cases[v][-1][1]
        assert [s["segment_id"] for s in segs] == list(range(len(segs)))
        assert all(a["end_sec"] == b["start_sec"] and a["label"] != b["label"] for a, b in zip(segs, segs[1:], strict=False))


def test_representative_sentence(spark):
    seg = spark.createDataFrame([("v", 0, 0.0, 10.0), ("v", 1, 10.0, 20.0)], "video_id string, segment_id int, start_sec double, end_sec double")
    t = text(spark, [(0, 2, "one", []), (2, 4, "middle", []), (4, 6, "three is longest", []), (12, 14, "no vector", [])])
    v = spark.createDataFrame([("v", 0, [1.0, 0.0]), ("v", 1, [1.0, 1.0]), ("v", 2, [0.0, 1.0])], "video_id string, id int, embedding array<double>")
    got = {r["segment_id"]: r["text"] for r in export.representative_sentence(seg, t, v, "segment_id", 200).collect()}
    assert got == {0: "middle", 1: "no vector"}
    assert {r["text"] for r in export.representative_sentence(seg, t, None, "segment_id", 5).collect()} == {"three", "no ve"}


def test_chapters_and_skips(spark):
    s = spark.createDataFrame(seg_rows([(0, 5, "core_content", 0.5, [], ""), (5, 9, "core_content", 0.7, [], ""), (9, 12, "recap", 0.1, [], ""), (12, 20, "core_content", 0.5, [], "")]), SEG)
    got = export.chapters(s, text(spark, [(1, 2, "wordy " * 30, [])]), None).orderBy("chapter_id").collect()
    assert [(r["start_sec"], r["end_sec"]) for r in got] == [(0, 9), (12, 20)]
    assert got[0]["title"].endswith("...") and len(got[0]["title"]) <= 80 and got[1]["title"] == "Chapter 2"
    assert export.skip_list(s).first()["skip_suggestions"] == [2]


def test_document_and_validation(spark):
    s = spark.createDataFrame(seg_rows([(0, 5, "core_content", 0.5, [], "")]), SEG)
    info = spark.createDataFrame([("v", "v.mp4", 5.0, 30.0, 4, 4), ("w", "w.mp4", 5.0, 30.0, 4, 4)], "video_id string, filename string, duration_sec double, fps double, width int, height int")
    docs = {r["video_id"]: r["metadata"] for r in export.documents(info, s, export.chapters(s, text(spark, [(1, 2, "x", [])]), None)).collect()}
    assert len(docs["v"]["segments"]) == 1 and docs["v"]["chapters"][0]["title"] == "x" and docs["w"]["segments"] == []
    bad = s.withColumn("label", F.lit("nonsense"))
    assert export.broken_segments(bad).count() == 1 and export.broken_segments(s).count() == 0
    with pytest.raises(Exception, match=r"invalid document of v: segments\[0\].label"):
        export.documents(info, bad, export.chapters(s, text(spark, [(1, 2, "x", [])]), None)).collect()


def test_violations_of_documents(spark):
    info = '{"filename": "v", "duration_sec": 0.0, "fps": 0.1, "width": 1, "height": 1}'
    segment = '{"segment_id": 0, "start_sec": 0, "end_sec": 0, "label": "intro", "confidence": 1, "evidence": {"visual_score": 7}}'
    cases = {
        f'{{"video_info": {info}, "segments": [], "chapters": []}}': [],
        f'{{"video_info": {info}, "segments": [{segment}], "chapters": [{{"chapter_id": 0, "start_sec": 0, "end_sec": 0, "title": ""}}]}}': [],
        f'{{"video_info": {info.replace("0.1", "0.0").replace("1}", "-1}")}, "segments": [{segment}, null], "chapters": []}}': ["video_info.fps", "video_info.height", "segments[1]"],
        f'{{"video_info": {info}, "segments": [{segment.replace("1, ", "1.01, ")}, {segment.replace("intro", "ad").replace("end_sec", "e")}]}}': ["segments[0].confidence", "segments[1].end_sec", "segments[1].label", "chapters"],
        f'{{"segments": [{segment.replace("0,", "-1,")}], "chapters": [{{"chapter_id": -1, "start_sec": 0}}]}}': ["video_info", "segments[0].segment_id", "segments[0].start_sec", "segments[0].end_sec", "chapters[0].chapter_id", "chapters[0].end_sec", "chapters[0].title"],
    }
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, j string").select("k", F.from_json("j", schemas.METADATA).alias("metadata"))
    assert [r["v"] for r in docs.orderBy("k").select(export.violations(F.col("metadata")).alias("v")).collect()] == list(cases.values())
    none = docs.limit(1).select(F.lit(None).cast(schemas.METADATA).alias("metadata"))
    assert none.select(export.violations(F.col("metadata"))).first()[0] == ["metadata"]


def named(spark, taken, wanted, **how):
    names = spark.createDataFrame([(n,) for n in taken], "name string")
    rows = review.free_names(spark.createDataFrame(list(enumerate(wanted)), "upload int, stem string"), names, **how).collect()
    assert sorted(r["upload"] for r in rows) == list(range(len(wanted))) and all(r["stem"] == wanted[r["upload"]] for r in rows)
    return sorted((r["stem"] or "", r["name"] or "") for r in rows)


def plain_names(taken, wanted):
    """One after another: stems that are free first, then numbers from two on."""
    used, out, rest = set(taken), [], []
    for stem in wanted:
        if stem is None:
            out.append(("", ""))
        elif stem in used:
            rest.append(stem)
        else:
            used.add(stem)
            out.append((stem, stem))
    for stem in rest:
        k = next(k for k in range(2, 10_000) if f"{stem}_{k}" not in used)
        used.add(f"{stem}_{k}")
        out.append((stem, f"{stem}_{k}"))
    return sorted(out)


def test_free_names(spark):
    assert named(spark, ["a", "a_2"], ["a", "a"]) == [("a", "a_3"), ("a", "a_4")]
    assert named(spark, ["a", "a_02", "a_2_2"], ["a"]) == [("a", "a_2")]
    rng = random.Random(3)
    taken = [f"{rng.choice('ab')}_{rng.randint(0, 30)}" for _ in range(20)] + ["a", "a_5_3", "b_007", "a_99999999999999999999", None]
    wanted = [rng.choice(["a", "b", "c", "a_5", "a_6", "b_2_2", "a_", None]) for _ in range(120)]
    expected = plain_names([n for n in taken if n], wanted)
    assert named(spark, taken, wanted) == expected and named(spark, taken, wanted, parts=3, width=4) == expected
    assert named(spark, [], []) == [] and named(spark, [], ["a"]) == [("a", "a")]


def test_review(spark):
    seg = spark.createDataFrame([("v", 0, 0.0, 5.0, "core_content"), ("v", 1, 5.0, 9.0, "recap")], "video_id string, segment_id int, start_sec double, end_sec double, label string")
    now = spark.createDataFrame([("v", 1.0), ("v", 4.96), ("v", 6.0)], "video_id string, now double")
    assert sorted((r["now"], r["segment_id"]) for r in review.next_segment(now, seg).collect()) == [(1.0, 1)]
    assert [(r["now"], r["target"]) for r in review.skip_target(now, seg).collect()] == [(6.0, 9.05)]
    names = spark.createDataFrame([("a",), ("a_2",), ("a_4",), ("b_2",)], "name string")
    wanted = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b_2")], "upload int, stem string")
    assert {tuple(r) for r in review.free_names(wanted, names).collect()} == {(1, "a", "a_3"), (2, "b", "b"), (3, "b_2", "b_2_2")}
    log = spark.createDataFrame([("j", 1.0, "queued"), ("j", 2.0, "running"), ("j", 5.5, "done"), ("k", 1.0, "queued")], "job_id string, ts double, status string")
    assert {tuple(r) for r in review.job_status(log, F.lit(9.0)).collect()} == {("j", "done", 3.5), ("k", "queued", 0.0)}


def test_replace_marks_as_verified(spark):
    schema = "video_id string, metadata struct<video_info:struct<filename:string,verified_by_human:boolean>>"
    docs = spark.createDataFrame([("a", (("a.mp4", False),)), ("b", (("b.mp4", False),))], schema)
    edit = spark.createDataFrame([("a", (("new.mp4", False),)), ("zzz", (("z.mp4", False),))], schema)
    got = {r["video_id"]: tuple(r["metadata"]["video_info"]) for r in review.replaced(docs, edit).collect()}
    assert got == {"a": ("new.mp4", True), "b": ("b.mp4", False)}


def test_text_functions(spark):
    rows = [("Today's VIDEO is brought to you by X, use code Y. Welcome back",), ("nothing",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(fx.matched_keywords(F.col("t"))).collect()]
    assert got == [["sponsor:today's video is brought to you by", "intro:welcome back"], [], []]
    names = spark.createDataFrame([("My video!.mp4",), ("...",), ("a.b.mp4",), (".mp4",)], "n string")
    assert [r[0] for r in names.select(fx.safe_stem(F.col("n"))).collect()] == ["My_video", "video", "a.b", "mp4"]
    assert spark.sql("select 1").select(fx.audio_class(F.lit(0.0005), F.lit(0.5)), fx.audio_class(F.lit(0.5), F.lit(0.2)), fx.audio_class(F.lit(0.5), F.lit(0.0)), fx.audio_class(F.lit(0.005), F.lit(0.0))).first()[:] == (
        "silence",
        "speech",
        "music",
        "noise",
    )


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    row = df.select(fx.cosine(a, b), fx.rms(a), fx.entropy(a), fx.weighted_centre(a, b), fx.weighted_spread(a, b), fx.softmax(a), fx.histogram_distance(a, b)).first()
    p = np.array([3, 4]) / 7
    assert row[0] == pytest.approx(0.96) and row[1] == pytest.approx(np.sqrt(12.5)) and row[2] == pytest.approx(-(p @ np.log2(p)), abs=1e-9)
    assert row[3] == pytest.approx(24 / 7) and row[5][0] == pytest.approx(1 / (1 + np.e)) and row[6] == pytest.approx(2.0)


def test_sound():
    t = np.arange(16000) / 16000
    tone = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    noise = np.random.default_rng(0).normal(0, 0.3, 16000).astype(np.float32)
    rms, centroid, bandwidth, zcr, entropy = signals.chunk_features(tone)
    assert rms == pytest.approx(np.sqrt(0.5), abs=1e-3) and 400 < centroid < 700 and zcr == pytest.approx(2 * 440 / 16000, rel=0.1)
    other = signals.chunk_features(noise)
    assert other[4] > entropy and other[1] > centroid and other[3] > zcr and other[2] > bandwidth
    assert signals.chunk_features(np.empty(0)) == (0.0,) * 5


def test_pictures(spark):
    black, white = np.zeros((16, 16, 3), np.uint8), np.full((16, 16, 3), 255, np.uint8)
    noise = np.random.default_rng(0).integers(0, 256, (16, 16, 3)).astype(np.uint8)
    assert signals.detail_energy(signals.grey(black)) == 0 and signals.detail_energy(signals.grey(noise)) > 0 and signals.detail_energy(np.zeros((4, 4))) == 0
    pictures = {"0": black, "1": white, "2": None, "3": noise, "4": noise}
    rows = [("v", int(k), float(k), k.encode()) for k in pictures]
    df = spark.createDataFrame(rows, "video_id string, frame_index int, timestamp_sec double, content binary")
    got = {r["frame_index"]: r for r in signals.frame_features(df, lambda b: pictures[bytes(b).decode()]).collect()}
    assert set(got) == {0, 1, 3, 4} and got[0]["is_black_frame"] and not got[1]["is_black_frame"]
    assert got[1]["motion_intensity"] == 255 and got[1]["is_hard_cut"] and got[4]["motion_intensity"] == 0 and got[4]["hist_diff_to_previous"] == 0


def test_speech_seconds(spark):
    seconds = spark.createDataFrame([("v", t) for t in range(5)], "video_id string, t int")
    spoken = spark.createDataFrame([("v", 0.5, 2.1), ("v", 3.0, 3.0), ("v", 4.9, 9.0)], "video_id string, start double, end double")
    assert sorted(r["t"] for r in signals.speech_seconds(spoken, seconds).collect()) == [0, 1, 2, 4]


def test_planned(spark):
    df = spark.createDataFrame([("visit www.shop.com",), ("only $9.99",), ("call 555-123-4567",), ("ORDER NOW",), ("Brand™",), ("plain words",), (None,)], "t string")
    assert [r[0] for r in df.select(planned.commercial(F.col("t"))).collect()] == [True] * 5 + [False] * 2
    g = spark.createDataFrame([("v", 0, 1.0), ("v", 1, None), ("v", 2, 4.0)], "video_id string, t int, x double")
    assert [r["x"] for r in planned.carried_forward(g, "x").orderBy("t").collect()] == [1.0, 1.0, 4.0]
    assert [r["x"] for r in planned.rolling_mean(g, "x", 1).orderBy("t").collect()] == [1.0, 2.5, 4.0]
    a = spark.createDataFrame([("v", 1), ("w", 5), ("x", 1)], "video_id string, modified int")
    b = spark.createDataFrame([("v", 2), ("w", 3)], "video_id string, finished int")
    assert {r["video_id"] for r in planned.stale(a, b).collect()} == {"w", "x"}


def test_spans_that_meet_are_paired_once(spark):
    rng = random.Random(5)
    spans = lambda n: [(v, k, a, a + rng.choice([0, 1, 40, 700])) for k in range(n) for v in "vw" for a in [float(rng.randrange(-50, 2000))]]
    left, right = spans(40), spans(60)
    a = spark.createDataFrame(left, "video_id string, l long, a double, b double")
    b = spark.createDataFrame(right, "video_id string, r long, c double, d double")
    got = sorted((r["video_id"], r["l"], r["r"]) for r in overlap.meeting(a, ("a", "b"), b, ("c", "d")).filter("c <= b and a <= d").collect())
    assert got == sorted((v, k, j) for v, k, s, e in left for w, j, c, d in right if v == w and c <= e and s <= d)


def test_seconds_inside_segments(spark):
    g = spark.createDataFrame([("v", t) for t in range(10)] + [("w", 0)], "video_id string, t int")
    seg = spark.createDataFrame([("v", 0, 2, 4), ("v", 3, 6, 9)], "video_id string, segment_id int, start_sec int, end_sec int")
    got = sorted((r["t"], r["segment_id"]) for r in classify.inside(g, seg).collect())
    assert got == [(2, 0), (3, 0), (6, 3), (7, 3), (8, 3)]


def test_grid_of_some_sources(spark):
    durations = spark.createDataFrame([("v", 2.5), ("none", 0.0)], "video_id string, duration_sec double")
    t = text(spark, [(1, 9, "late", [])])
    got = align.build_grid(durations, text=t).orderBy("t").collect()
    assert [(r["video_id"], r["t"], r["has_text"]) for r in got] == [("v", 0, 0), ("v", 1, 1), ("v", 2, 1)]
    assert align.build_grid(durations).columns == ["video_id", "t"]
