import datetime as dt
import json
import time
import wave

import numpy as np
from pyspark.sql import functions as F

from cadenza.__main__ import segmented
from cadenza.sources import files
from cadenza.streaming import live


def test_json_documents(spark, tmp_path):
    folder = tmp_path / "a" / "features"
    folder.mkdir(parents=True)
    segment = {"start": 0.0, "end": 1.0, "is_speech": True, "rms_energy": 0.1, "audio_class": "music", "extra": 1}
    (folder / "audio.json").write_text(json.dumps({"model_used": "m", "segments": [segment, segment | {"start": 1.0}]}, indent=1))
    got = files.audio_features(spark, str(folder)).orderBy("pos").collect()
    assert [(r["pos"], r["start"], r["is_speech"], r["zero_crossing_rate"]) for r in got] == [(0, 0.0, True, None), (1, 1.0, True, None)]


def test_metadata_with_unknown_keys(spark, tmp_path):
    folder = tmp_path / "v"
    folder.mkdir()
    doc = {"video_info": {"filename": "v.mp4", "colour": 1}, "segments": [{"segment_id": 0, "odd": 1}, {"segment_id": 1}], "chapters": [], "skip_suggestions": [], "top": 0}
    (folder / "metadata.json").write_text(json.dumps(doc))
    row = files.metadata_documents(spark, str(folder)).first()
    assert row["video_id"] == "v" and sorted(row["unknown"]) == ["colour", "odd", "top"] and row["metadata"]["segments"][1]["segment_id"] == 1


def test_sound_files(spark, tmp_path):
    with wave.open(str(tmp_path / "talk.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(np.zeros(40000, "<i2").tobytes())
    got = files.second_chunks(spark, str(tmp_path)).select("video_id", "t", F.size("samples").alias("n")).orderBy("t").collect()
    assert [tuple(r) for r in got] == [("talk", 0, 16000), ("talk", 1, 16000), ("talk", 2, 8000)]


def test_recordings_and_frames(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"x")
    (tmp_path / "empty.mp4").write_bytes(b"")
    (tmp_path / "b.txt").write_bytes(b"x")
    assert [tuple(r)[::2] for r in files.recordings(spark, str(tmp_path)).collect()] == [("a", 1)]
    frames = tmp_path / "ws" / "vid" / "frames"
    frames.mkdir(parents=True)
    for k in (0, 12):
        (frames / f"frame_{k:06d}.jpg").write_bytes(b"x")
    got = files.frame_files(spark, str(frames)).orderBy("frame_index").collect()
    assert [(r["video_id"], r["frame_index"], r["timestamp_sec"]) for r in got] == [("vid", 0, 0.0), ("vid", 12, 12.0)]


def test_stages_are_replaced_by_recording(spark, tmp_path):
    path = str(tmp_path / "stage")
    files.write_stage(spark.createDataFrame([("a", 1), ("b", 1)], "video_id string, x int"), path)
    files.write_stage(spark.createDataFrame([("a", 2)], "video_id string, x int"), path)
    assert {(r["video_id"], r["x"]) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 1)}


def test_documents_are_written(spark, tmp_path):
    docs = spark.createDataFrame([("a", ("x",))], "video_id string, metadata struct<name:string>")
    files.write_documents(docs, str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).first()["value"] == '{"name":"x"}'


def test_quiet_sessions(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("v", base + dt.timedelta(seconds=s)) for s in (0, 1, 5, 10)]
    got = live.quiet_sessions(spark.createDataFrame(rows, "video_id string, ts timestamp")).orderBy("start").collect()
    assert [r["n"] for r in got] == [3, 1]  # four seconds apart still touch


def test_streams(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("v", k, base + dt.timedelta(seconds=k // 2), float(k)) for k in range(8)]
    spark.createDataFrame(rows + rows[:2], "video_id string, event_id int, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video_id string, event_id int, ts timestamp, value double").parquet(str(tmp_path / "in"))
    for name, df in (("grid", live.live_grid(stream)), ("unique", live.unique_events(stream))):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert spark.table("grid").columns == ["video_id", "start", "n", "top"]
    assert sorted(r["event_id"] for r in spark.table("unique").collect()) == list(range(8))
    batch = live.live_grid(live.unique_events(spark.read.parquet(str(tmp_path / "in")))).collect()
    assert sorted(r["n"] for r in batch) == [2, 2, 2, 2]


def test_thinned_stream(spark, tmp_path):
    spark.createDataFrame([("v", t) for t in (0, 1, 3, 4, 9)] + [("w", 2)], "video_id string, t int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video_id string, t int").parquet(str(tmp_path / "in"))
    q = live.thinned(stream).writeStream.outputMode("append").format("memory").queryName("thin").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("thin").collect()) == [("v", 0), ("v", 3), ("v", 9), ("w", 2)]


def test_thinned_stream_forgets(spark, tmp_path):
    """A recording that was idle for a moment begins anew, so its next candidate is kept however near it is."""
    folder = tmp_path / "in"
    folder.mkdir()
    spark.createDataFrame([("v", 5)], "video_id string, t int").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("video_id string, t int").parquet(str(folder))
    q = live.thinned(stream, idle="1 second").writeStream.outputMode("append").format("memory").queryName("forgetful").start()
    try:
        until = dt.datetime.now() + dt.timedelta(seconds=90)
        while spark.table("forgetful").count() < 1 and dt.datetime.now() < until:
            time.sleep(0.5)
        states = lambda: (q.lastProgress or {}).get("stateOperators", [{}])[0].get("numRowsTotal")
        while states() != 0 and dt.datetime.now() < until:
            time.sleep(0.5)
        spark.createDataFrame([("v", 6)], "video_id string, t int").coalesce(1).write.mode("append").parquet(str(folder))
        while spark.table("forgetful").count() < 2 and dt.datetime.now() < until:
            time.sleep(0.5)
        assert sorted(r["t"] for r in spark.table("forgetful").collect()) == [5, 6]
    finally:
        q.stop()


def test_segmenting_files(spark, tmp_path):
    root = tmp_path / "workspaces"
    for name, spoken in (("talk", True), ("mute", False), ("unfinished", False)):
        features = root / name / "features"
        features.mkdir(parents=True)
        (root / name / "meta_raw.json").write_text(json.dumps({"filename": f"{name}.mp4", "duration_sec": 29.5, "fps": 30.0, "width": 640, "height": 360}))
        second = {"is_speech": True, "rms_energy": 0.5, "spectral_centroid": 0.0, "spectral_bandwidth": 0.0, "zero_crossing_rate": 0.2, "spectral_entropy": 0.0, "audio_class": "speech"}
        (features / "audio_features.json").write_text(json.dumps({"model_used": "m", "segments": [second | {"start": float(t), "end": t + 1.0} for t in range(30)]}))
        if name != "unfinished":
            frame = {"hist_diff_to_previous": 0.1, "is_hard_cut": False, "clip_labels": {"person talking": 0.8, "title card": 0.2}}
            (features / "visual_features.json").write_text(json.dumps({"model_used": "m", "frames": [frame | {"frame_index": t, "timestamp_sec": float(t)} for t in range(30)]}))
        if spoken:
            sentence = {"id": 0, "start": 1.0, "end": 4.0, "text": " A sentence. ", "similarity_to_next": None, "is_potential_boundary": False, "matched_keywords": []}
            (features / "text_features.json").write_text(json.dumps({"model_used": "m", "segments": [sentence]}))
    assert segmented(spark, str(root), str(tmp_path / "out"))
    got = {}
    for name in ("talk", "mute"):
        (found,) = (tmp_path / "out" / f"video_id={name}").glob("*.txt")
        got[name] = json.loads(found.read_text())
    assert not (tmp_path / "out" / "video_id=unfinished").exists()
    assert got["talk"]["segments"][0]["summary"] == "A sentence." and got["mute"]["segments"][0]["summary"] == ""
    assert all(d["segments"][-1]["end_sec"] == 30 and d["segments"][0]["label"] == "core_content" for d in got.values())
    (tmp_path / "none").mkdir()
    assert not segmented(spark, str(tmp_path / "none"), str(tmp_path / "out"))


def matrix_file(folder, x, name="text_embeddings.npy"):
    folder.mkdir(parents=True, exist_ok=True)
    np.save(folder / name, x)
    return folder / name


def test_matrices(spark, tmp_path):
    x = np.arange(12.0).reshape(4, 3)
    root = tmp_path / "ws"
    for name, of in (("f4", x.astype("<f4")), ("f8", x), ("big", x.astype(">f4")), ("columns", np.asfortranarray(x)), ("ints", x.astype(np.int16)), ("half", x.astype(np.float16)), ("wide", np.zeros((2, 5000), np.float32))):
        matrix_file(root / name / "features", of)
    for name, of in (("empty", np.empty((0, 384), np.float32)), ("flat", x[0]), ("cube", np.zeros((2, 2, 2))), ("words", np.array([["a", "b"]])), ("objects", np.array([[{}, 1]], object))):
        matrix_file(root / name, of)
    cut = matrix_file(root / "cut", x)
    cut.write_bytes(cut.read_bytes()[:-8])
    (root / "text").mkdir()
    (root / "text" / "text_embeddings.npy").write_bytes(b"not a matrix")
    (root / "nothing").mkdir()
    (root / "nothing" / "text_embeddings.npy").write_bytes(b"")
    rows = files.matrices(spark, str(root)).collect()
    assert {r["video_id"] for r in rows if r["problem"]} == {"flat", "cube", "words", "objects", "cut", "text"}
    got = {}
    for r in rows:
        if r["problem"] is None:
            got.setdefault(r["video_id"], {})[r["id"]] = r["embedding"]
    assert set(got) == {"f4", "f8", "big", "columns", "ints", "half", "wide"} and len(got["wide"][1]) == 5000
    assert all([got[name][k] for k in range(4)] == x.tolist() for name in ("f4", "f8", "big", "columns", "ints", "half"))


def workspace(root, name, seconds=60, **given):
    """A recording on disk: pictures always, and of sound, sentences and vectors what is given."""
    features = root / name / "features"
    features.mkdir(parents=True, exist_ok=True)
    (root / name / "meta_raw.json").write_text(json.dumps({"filename": f"{name}.mp4", "duration_sec": float(seconds), "fps": 30.0, "width": 640, "height": 360}))
    frame = {"hist_diff_to_previous": 0.1, "is_hard_cut": False, "clip_labels": {"person talking": 0.8, "title card": 0.2}}
    (features / "visual_features.json").write_text(json.dumps({"model_used": "m", "frames": [frame | {"frame_index": t, "timestamp_sec": float(t), "is_hard_cut": t == 30} for t in range(seconds)]}))
    if "sound" in given:
        with wave.open(str(root / name / "audio_processed.wav"), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
            w.writeframes((given["sound"] * 32767).astype("<i2").tobytes())
    if "speech" in given:
        (root / name / "speech.json").write_text(json.dumps({"segments": [{"start": s, "end": e} for s, e in given["speech"]]}))
    if "sentences" in given:
        rows = [{"id": k, "start": s, "end": e, "text": t} for k, (s, e, t) in enumerate(given["sentences"])]
        (root / name / "transcript.json").write_text(json.dumps({"language": "en", "duration_sec": float(seconds), "model": "m", "full_text": "", "segments": rows}))
    if "vectors" in given:
        matrix_file(features, np.asarray(given["vectors"], np.float32))


def written_documents(folder):
    return {f.parent.name.partition("=")[2]: json.loads(f.read_text()) for f in folder.glob("video_id=*/*.txt")}


def test_files_to_documents(spark, tmp_path):
    """Sound, sentences and vectors of a minute become features, and these a document; vectors decide its summaries."""
    root, noise = tmp_path / "ws", np.random.default_rng(1).uniform(-0.5, 0.5, 16000 * 60)
    noise[: 16000 * 8] = 0
    sentences = [(1, 9, "welcome back to the show"), (10, 18, "the middle one"), (19, 28, "the longest sentence of them all by far"), (32, 40, "a word from nobody"), (41, 55, "another long sentence ends it")]
    vectors = [[1, 0.1, 0], [1, 0.5, 0], [0.2, 1, 0], [0, 0, 1], [0, 0.1, 1]]
    speech = [(8.5, 59.0)]
    workspace(root, "007", sound=noise, speech=speech, sentences=sentences, vectors=vectors)
    workspace(root, "plain", sound=noise, speech=speech, sentences=sentences)
    workspace(root, "odd", sound=noise, speech=speech, sentences=sentences, vectors=[1.0, 2.0])
    workspace(root, "mute", sound=noise)
    workspace(root, "nothing")
    assert segmented(spark, str(root), str(tmp_path / "out"), str(tmp_path / "features"))
    got = written_documents(tmp_path / "out")
    assert set(got) == {"007", "plain", "odd", "mute"}
    for d in got.values():
        assert d["segments"][-1]["end_sec"] == 60 and all(a["end_sec"] == b["start_sec"] for a, b in zip(d["segments"], d["segments"][1:], strict=False))
    first = {name: next(s for s in d["segments"] if s["start_sec"] <= 12 < s["end_sec"]) for name, d in got.items()}
    assert first["plain"]["summary"] == first["odd"]["summary"] == "the longest sentence of them all by far"
    assert first["007"]["summary"] == "the middle one" and first["mute"]["summary"] == ""
    assert {c["title"] for d in (got["007"], got["plain"]) for c in d["chapters"]} <= {t for _, _, t in sentences} and got["007"]["chapters"]
    sounds = {(r["video_id"], r["pos"]): r for r in spark.read.parquet(str(tmp_path / "features" / "audio_features")).selectExpr("cast(video_id as string)", "pos", "is_speech", "audio_class", "rms_energy").collect()}
    assert sounds["007", 3]["audio_class"] == "silence" and not sounds["007", 3]["is_speech"] and sounds["007", 8]["is_speech"] and sounds["mute", 20]["is_speech"]  # noise crosses zero like speech
    texts = {r["id"]: r for r in files.stored(spark, str(tmp_path / "features" / "text_features"), spark.createDataFrame([], "video_id string, id int, similarity_to_next double, matched_keywords array<string>").schema).filter("video_id = '007'").collect()}
    assert texts[0]["matched_keywords"] == ["intro:welcome back"] and abs(texts[0]["similarity_to_next"] - 1.05 / np.sqrt(1.01 * 1.25)) < 1e-6 and texts[4]["similarity_to_next"] is None
    # what is there stays, until it is forced
    workspace(root, "mute", sound=np.zeros(16000 * 60))
    for force, speaks in ((False, True), (True, False)):
        assert segmented(spark, str(root), str(tmp_path / "out"), str(tmp_path / "features"), force)
        kept = files.stored(spark, str(tmp_path / "features" / "audio_features"), spark.createDataFrame([], "video_id string, pos int, is_speech boolean").schema)
        assert kept.filter("video_id = 'mute' and is_speech").isEmpty() is not speaks and kept.filter("video_id = '007'").count() == 60
