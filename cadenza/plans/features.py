"""The feature stage: sound and text features of recordings, from their sound files, transcripts and sentence vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Config
from cadenza.functions import signals
from cadenza.functions.expressions import audio_class, cosine, matched_keywords


def sound(chunks: DataFrame, speech: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """The sound features of (video_id, t, samples), second by second.

    A second counts as speech if an interval of ``speech`` (video_id, start, end) touches it. Where no intervals are known at
    all (no voice detector ran), it does if its sound class is speech.
    """
    found = signals.sound_features(chunks)
    told = found.withColumn("audio_class", audio_class(F.col("rms_energy"), F.col("zero_crossing_rate"), config))
    if speech is None:
        spoken = told.withColumn("is_speech", F.col("audio_class") == "speech")
    else:
        touched = signals.speech_seconds(speech, told.select("video_id", "t")).withColumn("is_speech", F.lit(True))
        spoken = told.join(touched, ["video_id", "t"], "left").withColumn("is_speech", F.coalesce("is_speech", F.lit(False)))
    return spoken.select("video_id", F.col("t").alias("pos"), F.col("t").cast("double").alias("start"), (F.col("t") + 1).cast("double").alias("end"), "is_speech", *signals.FEATURES, "audio_class")


def text(transcript: DataFrame, vectors: DataFrame | None, config: Config = DEFAULT) -> DataFrame:
    """The text features of sentences (video_id, pos, id, start, end, text): the cosine of the vectors (video_id, id, embedding) of a
    sentence and the next, by place, and the phrases that it contains; without vectors no cosine is known."""
    told = transcript.select("video_id", "pos", "id", "start", "end", "text")
    if vectors is None:
        told = told.withColumn("similarity_to_next", F.lit(None).cast("double"))
    else:
        by_pos = Window.partitionBy("video_id").orderBy("pos")
        placed = told.join(vectors.select("video_id", F.col("id").alias("pos"), "embedding"), ["video_id", "pos"], "left")
        after = placed.withColumn("after", F.lead("embedding").over(by_pos))
        told = after.withColumn("similarity_to_next", cosine(F.col("embedding"), F.col("after"))).drop("embedding", "after")
    flagged = F.coalesce(F.col("similarity_to_next") < config.similarity, F.lit(False))
    return told.withColumns({"is_potential_boundary": flagged, "matched_keywords": matched_keywords(F.col("text"), config)})
