"""Planned signals: segments that recordings share, cepstra and drifts, against brute force."""

import math

import numpy as np

from cadenza.functions import signals
from cadenza.operators import episodes, planned

VECTORS = "video_id string, t int, vector array<double>"


def plain_matches(rows, threshold, best):
    fine = [(v, t, x) for v, t, x in rows if x and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    fine = [r for k, r in enumerate(fine) if r not in fine[:k]]  # repeated rows count once
    out = []
    for v, t, x in fine:
        found = [(-1.0 if x == y else -round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 9), w, s) for w, s, y in fine if w != v and len(x) == len(y)]
        out += [(v, t, w, s, -c) for c, w, s in sorted(f for f in found if -f[0] >= threshold)[:best]]
    return sorted(out)


def recordings(seed=1):
    """Six recordings of random seconds, into which three passages are copied at various places, two of them not quite the same."""
    rng = np.random.default_rng(seed)
    seconds = {f"v{k}": rng.standard_normal((60, 12)) for k in range(6)}
    jingle, recap, talk = rng.standard_normal((8, 12)), rng.standard_normal((12, 12)), rng.standard_normal((5, 12))
    for k in range(6):
        seconds[f"v{k}"][3 * k : 3 * k + 8] = jingle
    seconds["v1"][40:52], seconds["v4"][30:42] = recap, recap * 2 + rng.standard_normal((12, 12)) * 0.05
    seconds["v2"][50:55], seconds["v3"][20:25] = talk, talk + rng.standard_normal((5, 12)) * 0.02
    return [(v, t, x.tolist()) for v, of in seconds.items() for t, x in enumerate(of)]


def test_matches_are_those_of_all_pairs(spark, monkeypatch):
    rows = recordings()
    rows += [("v0", 100, None), ("v0", 101, []), ("v0", 102, [0.0] * 12), ("v0", 103, [float("nan")] * 12), ("v0", 104, [None] * 12), ("v7", 0, [1.0, 2.0]), ("v8", 0, [2.0, 4.0]), ("v8", 0, [2.0, 4.0])]
    expected = plain_matches(rows, 0.95, 4)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = sorted(tuple(r) for r in episodes.matches(df, threshold=0.95, best=4, missed=1e-6).collect())
    assert len(expected) > 150 and found == expected
    monkeypatch.setattr(episodes, "BLOCK", 3)  # buckets of several blocks
    monkeypatch.setattr("cadenza.operators.skew.SHARES", 20)  # the jingle's nodes are frequent
    assert sorted(tuple(r) for r in episodes.matches(df, threshold=0.95, best=4, missed=1e-6).collect()) == expected
    assert episodes.matches(spark.createDataFrame([], VECTORS)).collect() == []


def test_recall_at_the_usual_miss_rate(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.standard_normal((300, 24))
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    near = 0.96 * base + np.sqrt(1 - 0.96**2) * away  # all pairs close to the threshold
    rows = [("a", t, x.tolist()) for t, x in enumerate(base)] + [("b", t, x.tolist()) for t, x in enumerate(near)]
    found = {tuple(r)[:4] for r in episodes.matches(spark.createDataFrame(rows, VECTORS)).collect()}
    expected = {r[:4] for r in plain_matches(rows, 0.95, 20)}
    assert found <= expected and len(found) >= 0.98 * len(expected) and len(expected) >= 600


def test_repeated_segments(spark):
    match = episodes.matches(spark.createDataFrame(recordings(), VECTORS), missed=1e-6)
    found = {(r["video_id"], r["other_id"], r["shift"], r["start_sec"], r["end_sec"], r["n"]) for r in episodes.repeated_segments(match, 5).collect()}
    assert {("v0", "v1", 3, 0, 8, 8), ("v1", "v4", -10, 40, 52, 12), ("v2", "v3", -30, 50, 55, 5)} <= found
    assert len(found) == 15 + 2 and not any(r[5] < 5 for r in found)
    broken = spark.createDataFrame([("a", t, "b", t + 2, 1.0) for t in (0, 1, 2, 4, 5, 6, 7)] + [("b", 3, "a", 1, 1.0)], "video_id string, t int, other_id string, other_t int, cosine double")
    assert {tuple(r)[2:6] for r in episodes.repeated_segments(broken, 3).collect()} == {(2, 0, 3, 3), (2, 4, 8, 4)}


def plain_cepstrum(chunk, rate):
    """The definition, coefficient by coefficient."""
    padded = np.concatenate([np.zeros(1024), np.asarray(chunk, np.float64), np.zeros(1024)])
    to_mel = lambda f: 3 * f / 200 if f < 1000 else 15 + 27 * math.log(f / 1000) / math.log(6.4)
    to_hertz = lambda m: 200 * m / 3 if m < 15 else 1000 * math.exp((m - 15) * math.log(6.4) / 27)
    edges = [to_hertz(to_mel(rate / 2) * k / 129) for k in range(130)]
    loud = []
    for s in range(0, len(padded) - 2047, 512):
        power = np.abs(np.fft.fft(padded[s : s + 2048] * np.sin(np.pi * np.arange(2048) / 2048) ** 2)[:1025]) ** 2
        bands = []
        for a, b, c in zip(edges, edges[1:], edges[2:], strict=False):
            f = np.arange(1025) * rate / 2048
            weight = np.where(f <= b, (f - a) / (b - a), (c - f) / (c - b)).clip(0) * 2 / (c - a)
            bands.append(10 * math.log10(max(1e-10, float(weight @ power))))
        loud.append(bands)
    loud = np.maximum(loud, np.max(loud) - 80)
    return [float(np.mean([sum(x * math.cos(math.pi * k * (2 * n + 1) / 256) for n, x in enumerate(frame)) for frame in loud])) * math.sqrt((1 if k == 0 else 2) / 128) for k in range(20)]


def test_cepstra(spark):
    rng = np.random.default_rng(4)
    tone = np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    chunks = [tone, 0.1 * rng.standard_normal(8000), np.zeros(8000), tone[:700], tone[:1], np.repeat(tone[:1000], 8)]
    for c in chunks:
        assert np.allclose(signals.cepstrum(np.asarray(c, np.float32), 8000), plain_cepstrum(np.asarray(c, np.float32), 8000), atol=1e-6)
    assert np.allclose(signals.hertz(signals.mel(np.array([0.0, 440, 1000, 4000, 8000]))), [0, 440, 1000, 4000, 8000])
    rows = [("v", t, np.asarray(c, np.float32).tolist()) for t, c in enumerate(chunks)] + [("v", 9, None), ("w", 0, [])]
    got = {(r["video_id"], r["t"]): r["mfcc"] for r in signals.sound_cepstra(spark.createDataFrame(rows, "video_id string, t int, samples array<float>"), 8000).collect()}
    assert got["v", 9] == got["w", 0] == [0.0] * 20 and np.allclose(got["v", 1], plain_cepstrum(np.asarray(chunks[1], np.float32), 8000), atol=1e-4)


def plain_drift(vectors, near=3, far=15):
    out = {}
    for t, x in vectors.items():
        around = [y for s, y in vectors.items() if near <= abs(s - t) <= far]
        mean = np.sum(around, axis=0) if around else np.zeros(len(x))
        length = np.linalg.norm(x) * np.linalg.norm(mean)
        out[t] = None if length == 0 else 1 - float(np.dot(x, mean)) / length
    return out


def test_drifts(spark):
    rng = np.random.default_rng(5)
    vectors = {t: rng.standard_normal(5) for t in [*range(30), 33, 34, 60, 61]} | {20: np.zeros(5)}
    df = spark.createDataFrame([("v", t, x.tolist()) for t, x in vectors.items()] + [("w", 0, [1.0])], "video_id string, t int, vector array<double>")
    got = {(r["video_id"], r["t"]): r["drift"] for r in planned.style_drift(df).collect()}
    expected = plain_drift(vectors)
    assert got["w", 0] is None and got["v", 60] is None and got["v", 20] is None
    assert all((got["v", t] is None) == (x is None) and (x is None or abs(got["v", t] - x) < 1e-9) for t, x in expected.items())
    flat = spark.createDataFrame([("v", t, 0.6 if 2 <= t < 8 else 0.0) for t in range(20)], "video_id string, t int, drift double")
    late = spark.createDataFrame([("v", t, 0.5 if 7 <= t < 13 else None) for t in range(20)], "video_id string, t int, drift double")
    marks = spark.createDataFrame([("v", t, int(t == 12), int(t in (2, 14))) for t in range(20)], "video_id string, t int, commercial int, is_hard_cut int")
    either = planned.either_drift(flat, late)
    assert [tuple(r) for r in planned.ad_block(either.join(marks, ["video_id", "t"])).collect()] == [("v", 2, 13, 0.9)]
    assert not planned.ad_block(flat.join(marks, ["video_id", "t"])).collect()


def test_drift_of_known_size_equals_gathered_vectors(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [("a", t, [float(x) for x in rng.normal(size=3)]) for t in [*range(0, 40), *range(47, 60), 80]] + [("b", 0, [1.0, 0.0, 0.0]), ("c", 0, None), ("c", 3, [0.0, 0.0, 0.0]), ("c", 6, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "video_id string, t int, vector array<double>")
    expected = {(r["video_id"], r["t"]): r["drift"] for r in planned.style_drift(df).collect()}
    got = {(r["video_id"], r["t"]): r["drift"] for r in planned.with_drift(df, "drift", F.col("vector"), 3).collect()}
    assert got.keys() == expected.keys()
    assert all((got[k] is None) == (expected[k] is None) and (got[k] is None or abs(got[k] - expected[k]) < 1e-12) for k in got)


def test_blocks_are_told_by_windows_alone(spark):
    """No join: a broadcast of the grid's seconds went through the driver."""
    grid = spark.createDataFrame([(v, t, 0.5 if 5 <= t < 16 else 0.0, int(t == 9), int(t in cuts)) for v, cuts in (("both", (2, 18)), ("first", (2, 20)), ("late", (1, 19))) for t in range(30)], "video_id string, t int, drift double, commercial int, is_hard_cut int")
    found = planned.ad_block(grid)
    assert sorted(tuple(r) for r in found.collect()) == [("both", 5, 16, 0.9), ("first", 5, 16, 0.7), ("late", 5, 16, 0.7)]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_partitions_grow_with_the_seconds(spark, monkeypatch):
    from cadenza.operators import align
    from cadenza.sources import tables

    monkeypatch.setattr(tables, "ROWS", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    durations = spark.createDataFrame([(str(v), 90.0) for v in range(20)], "video_id string, duration_sec double")
    visual = spark.createDataFrame([(str(v), v, v + 0.5, 0.0, False, {"a": 0.5}) for v in range(20)], "video_id string, pos int, timestamp_sec double, hist_diff_to_previous double, is_hard_cut boolean, clip_labels map<string,double>")
    try:
        grid = align.build_grid(durations, visual=visual)
        assert "hashpartitioning(video_id" in (plan := grid._jdf.queryExecution().executedPlan().toString()) and ", 19), REPARTITION_BY_NUM" in plan
        assert grid.count() == 1800 and grid.filter("size(scene) = 1 and scene[0] = 0.5").count() == 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rounds_of_tables_find_the_same_matches(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 8))
    rows = [(f"v{k}", t, [float(x) for x in base[t] + rng.normal(size=8) * 0.05]) for k in range(4) for t in range(12)]
    df = spark.createDataFrame(rows, "video_id string, t int, vector array<double>")
    kept_tables = []
    monkeypatch.setattr(episodes, "kept", lambda d, *by, real=episodes.kept: kept_tables.append(d) or real(d, *by))
    told = []
    for size in (1000, 4):
        monkeypatch.setattr(episodes, "ROUND", size)
        kept_tables.clear()
        told.append((sorted(tuple(r) for r in episodes.matches(df, threshold=0.95, best=5).collect()), len(kept_tables)))
    assert told[0][0] == told[1][0] and told[0][0]
    assert told[0][1] == 3 and told[1][1] > 3
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def sources(spark):
    """Durations, and few rows of sound, pictures and text for long recordings."""
    durations = spark.createDataFrame([("v", 4000.0), ("w", 7.5), ("none", 0.0), ("silent", 30.0)], "video_id string, duration_sec double")
    heard = [("v", 0, 3.2, True, "speech"), ("v", 1, 3.9, False, "music"), ("v", 2, 4.0, True, "speech"), ("v", 3, 700.5, True, "music"), ("w", 4, 6.0, True, "speech"), ("w", 5, 99.0, True, "speech")]
    audio = spark.createDataFrame([(v, p, s, s + 1, x, 0.25 * p, 2.0 * p, 1.0, 0.5, 0.0, c) for v, p, s, x, c in heard], "video_id string, pos long, start double, end double, is_speech boolean, rms_energy double, spectral_centroid double, spectral_bandwidth double, zero_crossing_rate double, spectral_entropy double, audio_class string")
    seen = [("v", 0, 5.5, False, {"a": 0.75, "b": 0.25}), ("v", 1, 700.0, True, {"b": 0.5}), ("v", 2, 701.0, False, {"a": 0.75, "b": 0.25}), ("w", 3, 0.0, True, {"a": 1.0})]
    visual = spark.createDataFrame([(v, p, s, 0.5 * p, c, m) for v, p, s, c, m in seen], "video_id string, pos long, timestamp_sec double, hist_diff_to_previous double, is_hard_cut boolean, clip_labels map<string,double>")
    said = [("v", 0, 10.0, 14.5, 0.25), ("v", 1, 14.5, 15.0, None), ("w", 0, 5.0, 9.0, 0.125)]
    text = spark.createDataFrame([(v, p, p, s, e, "t", x) for v, p, s, e, x in said], "video_id string, pos int, id int, start double, end double, text string, similarity_to_next double")
    return durations, audio, visual, text


def test_stretches_stand_for_their_seconds(spark):
    """Few rows for long recordings, and the same runs, boundaries, means and features as of single seconds."""
    from pyspark.sql import functions as F

    from cadenza.operators import align, boundaries, classify, learn, runs

    durations, audio, visual, text = sources(spark)
    seconds, stretches = (f(durations, audio, visual, text).cache() for f in (align.build_grid, align.build_stretches))
    assert seconds.count() == 4038 and stretches.count() < 40
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(stretches.withColumn("t", F.explode(F.sequence("t", F.col("until") - 1))).drop("until")) == rows(seconds)
    repeated = stretches.withColumn("is_hard_cut", F.lit(1)).withColumn("text_sim_to_next", F.lit(0.0))  # what stretches of the grid itself never hold
    for a, b in ((seconds, stretches), (seconds.withColumns({"is_hard_cut": F.lit(1), "text_sim_to_next": F.lit(0.0)}), repeated)):
        assert rows(boundaries.candidates(a)) == rows(boundaries.candidates(b))
    for holds, least, gap in ((F.col("is_speech") == 0, 3, 0), (F.col("is_speech") == 0, 3, 2), (F.col("is_music") == 1, 1, 700)):
        assert rows(runs.runs(seconds, holds, least, gap)) == rows(runs.runs(stretches, holds, least, gap))
    segment = spark.createDataFrame([("v", 0, 0, 3), ("v", 1, 3, 600), ("v", 2, 600, 700), ("v", 4, 701, 3999), ("w", 0, 2, 8), ("silent", 0, 4, 29)], "video_id string, segment_id int, start_sec int, end_sec int")
    labels = align.scene_labels(visual)
    steps = [
        lambda g: classify.segment_means(g, segment),
        lambda g: classify.scene_means(g, segment),
        lambda g: classify.profile(g, segment, labels),
        lambda g: learn.segment_features(g, segment, learn.Features(2)),
        lambda g: classify.inside(g, segment).groupBy("video_id", "segment_id").agg(F.sum("n")),
    ]
    for step in steps:
        assert rows(step(seconds)) == rows(step(stretches))


def test_later_plans_keep_how_a_fixed_table_is_dealt_out(spark):
    """An adaptive plan forgets it; seconds were shuffled again, into partitions as large as 64 MB compressed."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from cadenza.sources.tables import kept

    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("video_id"), F.col("id").alias("t"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    table = kept(df, "video_id", "t", fixed=True)
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
    after = table.withColumn("before", F.lag("t").over(Window.partitionBy("video_id").orderBy("t"))).groupBy("video_id").agg(F.count("before").alias("n"))
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort " not in plan
    assert sorted(tuple(r) for r in after.collect()) == [(str(k), 143 - 1 if k < 6 else 142 - 1) for k in range(7)]


def test_means_of_scenes_make_no_row_for_each_scene(spark):
    """A second became five rows and a segment five groups, which were aggregated twice."""
    from pyspark.sql import functions as F

    from cadenza.operators import align, classify

    durations, audio, visual, text = sources(spark)
    grid, labels = align.build_stretches(durations, audio, visual, text).cache(), align.scene_labels(visual).cache()
    segment = spark.createDataFrame([("v", 0, 0, 3), ("v", 1, 3, 600), ("w", 0, 2, 8), ("silent", 0, 4, 29)], "video_id string, segment_id int, start_sec int, end_sec int")
    for found in (classify.profile(grid, segment, labels), classify.best_scene(classify.scene_means(grid, segment), labels)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan
    # against the sum of every second's vector
    seconds = {}
    for r in align.build_grid(durations, audio, visual, text).collect():
        seconds.setdefault(r["video_id"], {})[r["t"]] = r["scene"]
    known = {r["video_id"]: r["labels"] for r in labels.collect()}
    got = {(r["video_id"], r["segment_id"]): (r["prob"], r["scene"]) for r in classify.profile(grid, segment, labels).collect()}
    assert len(got) == segment.count()
    for r in segment.collect():
        vectors = [v for t, v in seconds[r["video_id"]].items() if r["start_sec"] <= t < r["end_sec"]]
        means = [round(sum(x) / len(x), 9) for x in zip(*vectors, strict=True)]
        expected = (max(means), known[r["video_id"]][means.index(max(means))]) if means else (None, None)
        assert got[r["video_id"], r["segment_id"]] == expected
    # vectors of several lengths, and none at all
    odd = spark.createDataFrame([("v", 0, [0.5]), ("v", 1, [0.5, 1.0]), ("v", 2, None)], "video_id string, t int, scene array<double>")
    one = spark.createDataFrame([("v", 0, 0, 2), ("v", 1, 2, 3)], "video_id string, segment_id int, start_sec int, end_sec int")
    assert [(r["segment_id"], r["probs"]) for r in classify.scene_means(odd, one).collect()] == [(0, [0.5, 1.0])]
    assert classify.scenes_of(odd) == 2 and classify.scenes_of(odd.filter("scene is null")) == 0
    assert classify.scene_means(odd.withColumn("scene", F.array().cast("array<double>")), one).isEmpty()


def test_short_spans_meet_few_others(spark):
    """Within stretches of five minutes every span of ten seconds met thirty others."""
    from cadenza.operators.overlap import meeting

    a = spark.range(600).selectExpr("'v' as video_id", "id", "id * 10 as a", "id * 10 + 10 as b")
    pairs = meeting(a, ("a", "b"), a.selectExpr("video_id", "id as other", "a as c", "b as d"), ("c", "d"))
    assert pairs.count() < 600 * 12
    assert pairs.filter("c < b and a < d").count() == 600


def test_scene_divergence_sums_a_vector_once(spark):
    import math

    from pyspark.sql import functions as F

    from cadenza.functions.expressions import scene_divergence

    told = spark.createDataFrame([([0.625, 0.25, 0.0], [0.0, 0.5, 2.0])], "p array<double>, q array<double>").select(scene_divergence(F.col("p"), F.col("q")).alias("d"))
    p, q = ([max(1e-9, min(1.0, x)) for x in v] for v in ([0.625, 0.25, 0.0], [0.0, 0.5, 2.0]))
    expected = sum(0.5 * (a / sum(p) - b / sum(q)) * math.log((a / sum(p)) / (b / sum(q))) for a, b in zip(p, q, strict=True))
    assert abs(told.first()["d"] - expected) < 1e-12
    plan = told._jdf.queryExecution().analyzed().toString()
    assert plan.count("greatest(") == 2  # one for each vector; sums within the function of a component clipped it again for each


def test_scene_labels_are_found_once(spark):
    """Each recording's first frame was looked for in three plans, each with the frames read again."""
    from cadenza.plans.fusion import Fusion

    durations, audio, visual, text = sources(spark)
    fusion = Fusion(durations, audio, visual, text)
    assert fusion.labels.count() == visual.select("video_id").distinct().count()
    plan = fusion.seconds._jdf.queryExecution().optimizedPlan().toString()
    assert "map_keys" not in plan and fusion.scenes == 2


def test_scenes_are_compared_side_by_side(spark):
    """Functions of components, which are no generated code, took half of the time of the candidates."""
    import random

    from cadenza.operators import align, boundaries

    rng = random.Random(4)
    odd = [[], None, [0.5], [0.25, 0.75], [0.75, 0.25], [2.0, -1.0], [0.0, 0.0, 0.0], [0.5, None, 0.5], [float("nan"), 0.5], [0.3, 0.2, 0.5]]
    rows = [("v", t, rng.choice(odd), 0, 0, 0, None) for t in range(400)]
    grid = spark.createDataFrame(rows, "video_id string, t int, scene array<double>, is_speech int, is_music int, is_hard_cut int, text_sim_to_next double")
    told = [sorted(map(tuple, boundaries.candidates(grid, scenes=n).collect())) for n in (3, 5, None, 1000)]
    assert told[0] == told[1] == told[2] == told[3] and 20 < len(told[0]) < 400
    stretches = align.build_stretches(*sources(spark))
    flat = boundaries.candidates(stretches, scenes=2)
    assert "zip_with" not in flat._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, boundaries.candidates(stretches).collect()))


def test_brief_stretches_keep_their_first_candidate(spark):
    import random
    from dataclasses import replace

    from cadenza.config import DEFAULT
    from cadenza.operators import boundaries

    rng = random.Random(5)
    seconds = sorted({rng.randrange(3000) for _ in range(900)})
    df = spark.createDataFrame([("v", t) for t in seconds], "video_id string, t int")
    for gap in (0, 1, 3, 7):
        kept = []
        for t in seconds:
            if not kept or t - kept[-1] >= gap:
                kept.append(t)
        kept = kept if kept[-1] == seconds[-1] else [*kept, seconds[-1]]
        assert boundaries.boundaries(df, replace(DEFAULT, min_gap=gap)).first()["boundaries"] == kept


def crowded(seed):
    """Recordings with crowds of near and parallel vectors: in many recordings, in a single one and in copies of it, of two lengths, whole and not."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-9, 9, (3, 8)).astype(float)
    rows = [(f"v{k % 23:02}", k, (base[k % 2] * 4 + rng.integers(-2, 3, 8)).tolist()) for k in range(240)]
    for of in ("a", "b"):  # a recording and its copy, each with more near seconds than a list holds of it
        rows += [(of, t, (base[2] * 3 + np.arange(8) % (2 + t % 7) * 0.25 * (t // 7 % 3)).tolist()) for t in range(60)]
    rows += [(f"p{k % 3}", k, (base[2] * (1 + k)).tolist()) for k in range(50)]  # parallel ones
    rows += [(f"q{k % 5}", k, [0.1 + k * 1e-4, 1e70, 1.0]) for k in range(20)]
    return rows


def test_crowds_are_matched_as_by_all_pairs(spark, monkeypatch):
    rows = crowded(5)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    for best in (2, 7):
        expected = plain_matches(rows, 0.95, best)
        for block, hits in ((episodes.BLOCK, 100_000), (20, 50)):  # few hits at a time, so bars rise early
            monkeypatch.setattr(episodes, "BLOCK", block)
            monkeypatch.setattr(episodes, "HITS", hits)
            found = sorted(tuple(r) for r in episodes.matches(df, threshold=0.95, best=best, missed=1e-6).collect())
            assert len(found) > 500 and [r[:4] for r in found] == [r[:4] for r in expected]
            assert np.allclose([r[4] for r in found], [r[4] for r in expected], atol=2e-9)


def written_by_shuffles(spark):
    """Bytes of each stage that were shuffled, by stage."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_a_crowd_is_dealt_out_once_a_table(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-40, 40, 32)
    rows = [(f"v{k % 400}", k, [float(x) for x in base + rng.integers(-3, 4, 32)]) for k in range(3000)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    before = set(written_by_shuffles(spark))
    assert episodes.matches(df, threshold=0.95, best=5, missed=1e-6).count() == 3000 * 5
    most = max(n for stage, n in written_by_shuffles(spark).items() if stage not in before)
    assert most < 3000 * 100 * episodes.ROUND
