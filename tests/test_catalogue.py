"""Queries against their SQL at the smallest scale, and the sixty-second recording end to end."""

import decimal
import glob
import math
import os
import random

import duckdb
import pytest

from cadenza import catalogue
from cadenza.config import LABELS
from cadenza.operators import export
from cadenza.plans.fusion import Fusion

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def as_rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str([plain(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", ["grid_text", "runs_ad_break", "rules_all", "boundaries", "segment_means", "smoothed", "representative_sentence", "job_status", "style_drift", "outro_of_spoken", "speech_seconds", "broken_segments", "broken_documents", "upload_names", "segment_features", "repeated_segments", "sound_cepstra", "sound_features", "frame_features", "sound_drift", "ad_block_of_drifts", "replaced_documents", "list_labels", "scene_map", "ocr_gate", "ad_block", "stale_results", "next_segment", "skip_target"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = catalogue.QUERIES[name](spark, SF)
    rel = con.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert as_rows(df.columns, [tuple(r) for r in df.collect()]) == as_rows(rel.columns, rel.fetchall())


def test_every_oracle_has_its_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def sixty_seconds(spark):
    """A recording of a minute: intro, core, sponsor, core, outro."""
    sections = [(5, "title card", 0.6, "music", False, 0.4), (25, "person talking", 0.7, "speech", True, 0.5), (35, "advertisement", 0.65, "music", True, 0.5), (55, "person talking", 0.7, "speech", True, 0.5), (60, "end credits", 0.7, "music", False, 0.3)]
    scenes = ["presentation slide", "person talking", "screen recording", "video game", "animated scene", "blank screen", "end credits", "title card", "advertisement", "sponsor logo"]
    at = lambda t: next(s for s in sections if t < s[0])
    audio = [("v", t, float(t), t + 1.0, at(t)[4], at(t)[5], 0.0, 0.0, 0.0, 0.0, at(t)[3]) for t in range(60)]
    visual = [("v", t, float(t), 0.7 if t in (5, 25, 35, 55) else 0.05, t in (5, 25, 35, 55), {s: at(t)[2] if s == at(t)[1] else 0.05 for s in scenes}) for t in range(60)]
    times = [(1, 4), (6, 12), (12, 18), (18, 24), (26, 30), (30, 34), (36, 44), (44, 52), (56, 59)]
    words = {0: ["intro:welcome back"], 4: ["sponsor:sponsored by"], 5: ["sponsor:use code"], 8: ["outro:thanks for watching"]}
    similar = {3: 0.15, 5: 0.2, 7: 0.25, 8: None}
    text = [("v", k, k, float(s), float(e), f"sentence number {k}", similar.get(k, 0.75), words.get(k, [])) for k, (s, e) in enumerate(times)]
    rng = random.Random(42)
    vectors = [("v", k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(9)]
    return Fusion(
        spark.createDataFrame([("v", 60.0)], "video_id string, duration_sec double"),
        spark.createDataFrame(audio, "video_id string, pos int, start double, end double, is_speech boolean, rms_energy double, spectral_centroid double, spectral_bandwidth double, zero_crossing_rate double, spectral_entropy double, audio_class string"),
        spark.createDataFrame(visual, "video_id string, pos int, timestamp_sec double, hist_diff_to_previous double, is_hard_cut boolean, clip_labels map<string,double>"),
        spark.createDataFrame(text, "video_id string, pos int, id int, start double, end double, text string, similarity_to_next double, matched_keywords array<string>"),
        spark.createDataFrame(vectors, "video_id string, id int, embedding array<double>"),
    )


def test_sixty_seconds(spark):
    f = sixty_seconds(spark)
    info = spark.createDataFrame([("v", "v.mp4", 60.0, 30.0, 1920, 1080)], "video_id string, filename string, duration_sec double, fps double, width int, height int")
    doc = f.documents(info).first()["metadata"]
    segs = doc["segments"]
    assert segs[0]["start_sec"] == 0 and segs[-1]["end_sec"] == 60
    assert all(a["end_sec"] == b["start_sec"] for a, b in zip(segs, segs[1:], strict=False))
    assert [s["segment_id"] for s in segs] == list(range(len(segs))) and {s["label"] for s in segs} <= set(LABELS)
    assert doc["skip_suggestions"] == [s["segment_id"] for s in segs if s["label"] != "core_content"]
    assert any(s["label"] == "sponsorship" and s["start_sec"] <= 30 < s["end_sec"] for s in segs)
    core = [(s["start_sec"], s["end_sec"]) for s in segs if s["label"] == "core_content"]
    assert all(any(a <= c["start_sec"] and c["end_sec"] <= b for a, b in core) for c in doc["chapters"])
    assert export.broken(f.documents(info)).count() == 0 and export.broken_segments(f.smoothed).count() == 0
