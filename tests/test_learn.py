"""The segment classifier on fixtures whose classes can be told apart."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import learn

FEATURES = learn.Features(2)
ROWS = "video_id string, segment_id int, label string, " + ", ".join(f"{n} double" for n in FEATURES.names)


def rows(seed, labels=("intro", "core_content", "dead_air"), videos=30):
    """Segments whose speech, energy and place follow from their label, with some noise and missing similarities."""
    rng = random.Random(seed)
    out = []
    for v in range(videos):
        for k in range(12):
            label = rng.choice(labels)
            of = {n: rng.gauss(0, 1) for n in FEATURES.names}
            of |= {"is_speech": {"dead_air": 0.0, "intro": 0.4}.get(label, 0.9) + rng.gauss(0, 0.05), "place": {"intro": 0.05}.get(label, 0.6) + rng.gauss(0, 0.05)}
            of["text_sim_to_next"] = None if rng.random() < 0.3 else of["text_sim_to_next"]
            out.append((f"v{v}", k, label, *of.values()))
    return out


def test_split_is_by_recording(spark):
    df = spark.createDataFrame([(f"v{k}",) for k in range(1000)] + [(None,)], "video_id string").withColumn("held", learn.held_out(F.col("video_id")))
    n = df.groupBy().agg(F.sum(F.col("held").cast("int"))).first()[0]
    assert 150 < n < 250 and not df.filter("video_id is null").first()["held"]


def test_held_out_segments_are_told_apart(spark, tmp_path):
    df = spark.createDataFrame(rows(1), ROWS)
    model = learn.train(df, FEATURES)
    test = df.filter(learn.held_out(F.col("video_id")))
    told = learn.predict(model, test)
    found = {r["label"]: r for r in learn.recalls(told).collect()}
    assert set(found) == {"intro", "core_content", "dead_air"} and all(r["n"] > 10 and r["recall"] > 0.95 for r in found.values())
    assert sum(r["n"] for r in learn.confusion(told).collect()) == test.count() and told.filter("probability < 0.33 or probability > 1").count() == 0
    learn.save(model, f"{tmp_path}/model")
    learn.save(model, f"{tmp_path}/model")  # in place of the old one
    again = learn.predict(learn.load(f"{tmp_path}/model"), test)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, told.collect()), key=repr)


def test_training_doesnt_see_held_out_labels(spark):
    df = spark.createDataFrame(rows(2), ROWS)
    wrong = df.withColumn("label", F.when(learn.held_out(F.col("video_id")), "outro").otherwise(F.col("label")))
    test = df.filter(learn.held_out(F.col("video_id"))).drop("label")
    first, second = (sorted(map(tuple, learn.predict(learn.train(x, FEATURES), test).collect()), key=repr) for x in (df, wrong))
    assert first == second


def test_missing_classes_and_odd_rows(spark):
    df = spark.createDataFrame(rows(3), ROWS)
    # a class that only held-out recordings have is never predicted, and counts as missed
    rare = df.withColumn("label", F.when(learn.held_out(F.col("video_id")) & (F.col("label") == "intro"), "outro").otherwise(F.col("label")))
    told = learn.predict(learn.train(rare, FEATURES), rare.filter(learn.held_out(F.col("video_id"))))
    found = {r["label"]: r["recall"] for r in learn.recalls(told).collect()}
    assert found["outro"] == 0.0 and told.filter("predicted = 'outro'").isEmpty()
    odd = df.limit(1).select("video_id", "segment_id", F.lit(None).cast("string").alias("label"), *[F.lit(None).cast("double").alias(n) for n in FEATURES.names])
    assert learn.predict(learn.train(df.union(odd), FEATURES), odd).first()["predicted"] is not None  # nulls become medians
    unknown = df.withColumn("text_sim_to_next", F.lit(None).cast("double"))
    assert learn.predict(learn.train(unknown, FEATURES), unknown).count() == df.count()  # a feature that nobody knows
    one = df.withColumn("label", F.lit("intro"))
    assert [r["predicted"] for r in learn.predict(learn.train(one, FEATURES), one).select("predicted").distinct().collect()] == ["intro"]
    with pytest.raises(ValueError, match="no labelled segment"):
        learn.train(df.filter("false"), FEATURES)


def test_features_of_segments(spark):
    grid = [("v", t, int(t < 2), float(t), 0, 0.5, int(t == 0), [0.25, 0.75] if t < 3 else [], None if t < 3 else 0.5, 1, t) for t in range(4)]
    names = "video_id string, t int, is_speech int, rms_energy double, is_music int, hist_diff double, is_hard_cut int, scene array<double>, text_sim_to_next double, has_text int, text_sentence_id int"
    segments = spark.createDataFrame([("v", 0, 0, 2), ("v", 2, 2, 4), ("w", 0, 0, 1)], "video_id string, segment_id int, start_sec int, end_sec int")
    got = {r["segment_id"]: r for r in learn.segment_features(spark.createDataFrame(grid, names), segments, FEATURES).collect()}
    assert set(got) == {0, 2} and got[0]["is_speech"] == 1 and got[2]["rms_energy"] == 2.5 and got[0]["text_sim_to_next"] is None and got[2]["text_sim_to_next"] == 0.5
    assert np.allclose([got[2]["scene_0"], got[2]["scene_1"], got[2]["seconds"], got[2]["place"]], [0.125, 0.375, 2, 0.75])
