"""A supervised classifier of segments: features of a segment, a training split by recording, a fitted and stored pipeline.

The split is by recording, so no segment of a held-out recording is ever seen in training, and it follows from the
recording's name alone, so it is the same in every job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.align import until
from cadenza.operators.classify import KEY, MEANS, inside, mean

#: Of this many recordings one is held out.
FOLDS = 5


def held_out(video_id: Column, folds: int = FOLDS) -> Column:
    """Whether a recording is held out; a null one is trained on."""
    return F.coalesce(F.crc32(video_id.cast("binary")) % folds == 0, F.lit(False))


@dataclass(frozen=True)
class Features:
    """Names of a segment's features: the means of the grid and of each scene, its length, and its place in the recording."""

    scenes: int
    names: list[str] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "names", [*MEANS, "text_sim_to_next", *[f"scene_{k}" for k in range(self.scenes)], "seconds", "place"])


def segment_features(grid: DataFrame, segment: DataFrame, features: Features) -> DataFrame:
    """(video_id, segment_id, start_sec, features by name) of each segment with seconds in the grid.

    One pass over the seconds. A scene vector of fewer scenes counts as zero in the others, and a similarity that is never
    known as null.
    """
    scenes = [mean(F.coalesce(F.get("scene", F.lit(k)), F.lit(0.0))).alias(f"scene_{k}") for k in range(features.scenes)]
    means = [mean(F.col(c)).alias(c) for c in [*MEANS, "text_sim_to_next"]]
    length = grid.groupBy("video_id").agg(F.max(until(grid)).alias("length"))
    found = inside(grid, segment).groupBy(*KEY, "start_sec", "end_sec").agg(*means, *scenes).join(length, "video_id")
    place = (F.col("start_sec") + F.col("end_sec")) / 2 / F.col("length")
    return found.withColumns({"seconds": (F.col("end_sec") - F.col("start_sec")).cast("double"), "place": place}).select(*KEY, "start_sec", *features.names)


def train(labelled: DataFrame, features: Features, *, label_col: str = "label", max_iter: int = 60, penalty: float = 1e-3) -> PipelineModel:
    """A fitted pipeline: missing features become medians, all are scaled, and a multinomial logistic regression is fitted.

    Rows without a label and held-out recordings take no part. A class that occurs in held-out recordings alone is never
    predicted. Raises ``ValueError`` without any row to train on.
    """
    rows = labelled.filter(F.col(label_col).isNotNull() & ~held_out(F.col("video_id"))).select(F.col(label_col).alias("label"), *features.names)
    if rows.isEmpty():
        raise ValueError("no labelled segment outside the held-out recordings")
    known = [c for c, n in rows.agg(*[F.count(c).alias(c) for c in features.names]).first().asDict().items() if n]
    labels = StringIndexer(inputCol="label", outputCol="class", stringOrderType="alphabetAsc").fit(rows)
    stages = [
        Imputer(inputCols=known, outputCols=[f"_{c}" for c in known], strategy="median"),
        VectorAssembler(inputCols=[f"_{c}" for c in known], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        LogisticRegression(featuresCol="scaled", labelCol="class", predictionCol="guess", probabilityCol="shares", maxIter=max_iter, regParam=penalty),
        IndexToString(inputCol="guess", outputCol="predicted", labels=labels.labels),
    ]
    fitted = Pipeline(stages=stages).fit(labels.transform(rows))
    return PipelineModel(fitted.stages)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` (with the features) and the predicted label with its probability."""
    told = model.transform(rows)
    return told.select(*rows.columns, "predicted", F.array_max(vector_to_array("shares")).alias("probability"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def confusion(predicted: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, predicted, n) over rows with a label."""
    return predicted.filter(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("label"), "predicted").agg(F.count("*").alias("n"))


def recalls(predicted: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, n, found, recall): how many segments of each label there are, and how many of them are predicted as it."""
    by_label = confusion(predicted, label_col).groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("found"))
    return by_label.withColumn("recall", F.col("found") / F.col("n"))
