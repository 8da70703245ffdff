"""Inputs of the segmentation operators out of the driver's tables.

A user's hours stand for a recording's seconds, and their events for audio and video frames; a conversation's turns are
the sentences of the recording of the same number, as long as their text; every fifty vectors belong to one recording. Values that
are averaged are multiples of powers of two, so that their sums don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.config import Config
from cadenza.functions.expressions import cosine, matched_keywords

#: Scene labels in order, and the event types that stand for them.
SCENES = (("person talking", "view"), ("presentation slide", "click"), ("advertisement", "purchase"), ("blank screen", "error"), ("title card", "signup"))
#: Phrases that occur in the synthetic prose, in place of those of real recordings.
PROSE = Config(
    keywords={
        "sponsor": ("onst ", "thand"),
        "intro": ("the and", "and the"),
        "outro": ("ing the", "of the"),
        "self_promo": ("ed to", "en la"),
        "recap": ("der ", "que "),
    }
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.expr("cast(timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) as int)")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("pos"), hour.alias("t"), "event_type", "value")


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recordings are as long as the last hour of any event."""
    length = events(spark, sf_dir).agg((F.max("t") + 1).cast("double")).scalar()
    return events(spark, sf_dir).select("video_id").distinct().withColumn("duration_sec", F.coalesce(length, F.lit(0.0)))


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    return events(spark, sf_dir).select(
        "video_id",
        "pos",
        (F.col("t") + 0.25).alias("start"),
        (F.col("t") + 1.25).alias("end"),
        F.col("event_type").isin("view", "click", "signup").alias("is_speech"),
        (F.floor("value") / 1024).alias("rms_energy"),
        (F.col("value") * 10).alias("spectral_centroid"),
        (F.col("value") * 5).alias("spectral_bandwidth"),
        (F.col("value") / 2000).alias("zero_crossing_rate"),
        zero.alias("spectral_entropy"),
        F.when(F.col("event_type") == "purchase", "music").otherwise("speech").alias("audio_class"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs = [F.when(F.col("event_type") == kind, 0.625).otherwise(0.09375) for _, kind in SCENES]
    return events(spark, sf_dir).select(
        "video_id",
        "pos",
        (F.col("t") + 0.25).alias("timestamp_sec"),
        (F.floor("value") / 512).alias("hist_diff_to_previous"),
        (F.col("value") > 150).alias("is_hard_cut"),
        F.map_from_arrays(F.array(*[F.lit(s) for s, _ in SCENES]), F.array(*probs)).alias("clip_labels"),
    )


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("int").alias("pos"), F.char_length("text").alias("n"), "text")
    up_to = F.sum("n").over(Window.partitionBy("video_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return turns.select("video_id", "pos", F.col("pos").alias("id"), ((up_to - F.col("n")) / 15).alias("start"), (up_to / 15).alias("end"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.floor(F.col("vec_id") / 50).cast("string").alias("video_id"), (F.col("vec_id") % 50).cast("int").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))


def similarity_to_next(sentence: DataFrame, vector: DataFrame) -> DataFrame:
    """Sentences with the cosine of their vector and the next sentence's; null for the last and without vectors."""
    by_pos = Window.partitionBy("video_id").orderBy("pos")
    told = sentence.join(vector, ["video_id", "id"], "left").withColumn("after", F.lead("embedding").over(by_pos))
    return told.withColumn("similarity_to_next", F.round(cosine(F.col("embedding"), F.col("after")) * 2**20) / 2**20).drop("embedding", "after")


def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = similarity_to_next(sentences(spark, sf_dir), vectors(spark, sf_dir))
    return told.withColumn("matched_keywords", matched_keywords(F.col("text"), PROSE))


#: Components of a line's vector.
LINE_SIZE = 32


def line_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, t, vector): documents stand for recordings and their lines for seconds; a line of three words or more has a
    vector, in which every word adds or takes one at a place given by its hash."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("video_id"), F.posexplode(F.split("text", "\n", -1)).alias("t", "line"))
    word = F.explode(F.regexp_extract_all(F.lower("line"), F.lit("[^ \\t\\r]+"), F.lit(0)))
    placed = lines.select("video_id", "t", word.alias("word")).withColumn("place", F.conv(F.substring(F.md5("word"), 1, 2), 16, 10).cast("int") % (2 * LINE_SIZE))
    components = [F.sum(F.when(F.col("place") == d, 1.0).when(F.col("place") == d + LINE_SIZE, -1.0).otherwise(0.0)) for d in range(LINE_SIZE)]
    return placed.groupBy("video_id", "t").agg(F.count("*").alias("n"), F.array(*components).alias("vector")).filter("n >= 3").select("video_id", "t", "vector")
