"""Files as tables: typed JSON documents, sound files, frames, recordings in a folder; and tables as documents."""

from __future__ import annotations

import io
import wave
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza import schemas


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON file of ``path``: video_id (the name of its folder) and the schema's columns."""
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return read.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1).alias("video_id"), "*")


def workspace_documents(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The JSON files called ``name`` anywhere below ``root``, one row each: video_id (the folder right below root) and the
    schema's columns. Recordings without such a file have no row, and there may be none at all."""
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    below = re.escape(root.rstrip("/").rpartition("/")[2])
    return read.select(F.regexp_extract(F.col("_metadata.file_path"), f"/{below}/([^/]+)/", 1).alias("video_id"), "*")


def _listed(documents: DataFrame, column: str) -> DataFrame:
    return documents.select("video_id", F.posexplode(column).alias("pos", "r")).select("video_id", "pos", "r.*")


def audio_features(spark: SparkSession, path: str) -> DataFrame:
    return _listed(json_documents(spark, path, schemas.AUDIO_FEATURES), "segments")


def visual_features(spark: SparkSession, path: str) -> DataFrame:
    return _listed(json_documents(spark, path, schemas.VISUAL_FEATURES), "frames")


def text_features(spark: SparkSession, path: str) -> DataFrame:
    return _listed(json_documents(spark, path, schemas.TEXT_FEATURES), "segments")


def transcript(spark: SparkSession, path: str) -> DataFrame:
    return _listed(json_documents(spark, path, schemas.TRANSCRIPT), "segments")


def metadata_documents(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, metadata, unknown): documents, and the keys in them that the schema doesn't know."""
    text = spark.read.text(path, wholetext=True)
    raw = text.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1).alias("video_id"), "value")
    return raw.select("video_id", F.from_json("value", schemas.METADATA).alias("metadata"), unknown_keys(F.col("value")).alias("unknown"))


def unknown_keys(document: Column) -> Column:
    """Keys of a metadata document that its schema doesn't know, at every level that forbids them."""

    def extra(found: Column, level: str) -> Column:
        known = F.array(*[F.lit(k) for k in schemas.METADATA_KEYS[level]])
        return F.array_except(F.coalesce(F.json_object_keys(found), F.array().cast("array<string>")), known)

    parts = [extra(document, ""), extra(F.get_json_object(document, "$.video_info"), "video_info")]
    for level in ("segments", "chapters"):
        items = F.from_json(F.get_json_object(document, f"$.{level}"), "array<string>")
        parts.append(F.flatten(_extras(items, level)))
    return F.array_distinct(F.concat(*parts))


def _extras(items: Column, level: str) -> Column:
    known = F.array(*[F.lit(k) for k in schemas.METADATA_KEYS[level]])
    none = F.array().cast("array<string>")
    return F.transform(F.coalesce(items, none), lambda x: F.array_except(F.coalesce(F.json_object_keys(x), none), known))


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, path, bytes) of the MP4 files of a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][pP]4").load(path)
    return files.filter("length > 0").select(stem(F.col("path")).alias("video_id"), "path", F.col("length").alias("bytes"))


def frame_files(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, frame_index, timestamp_sec, content) of frame images, one frame a second."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "frame_*").load(path)
    index = F.regexp_extract("path", r"frame_(\d+)", 1).cast("int")
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]*/[^/]*$", 1).alias("video_id"), index.alias("frame_index"), index.cast("double").alias("timestamp_sec"), "content")


def _workspace_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(video_id, content) of the files called ``name`` anywhere below ``root``; the recording is the folder right below it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    below = re.escape(root.rstrip("/").rpartition("/")[2])
    return found.select(F.regexp_extract("path", f"/{below}/([^/]+)/", 1).alias("video_id"), "content")


def _seconds(files: DataFrame, rate: int) -> DataFrame:
    """(video_id, t, samples) of (video_id, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for video, content in zip(pdf["video_id"], pdf["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    if (w.getframerate(), w.getnchannels(), w.getsampwidth()) != (rate, 1, 2):
                        raise ValueError(f"{video}: expected 16-bit mono sound at {rate} Hz")
                    t = 0
                    while len(raw := w.readframes(rate)):
                        samples = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
                        yield pd.DataFrame({"video_id": [video], "t": [t], "samples": [samples]})
                        t += 1

    return files.select("video_id", "content").mapInPandas(run, "video_id string, t int, samples array<float>")


def second_chunks(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """(video_id, t, samples) of 16-bit mono sound files: one row for each second, the last may be short."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return _seconds(files.select(stem(F.col("path")).alias("video_id"), "content"), rate)


def workspace_chunks(spark: SparkSession, root: str, name: str = "audio_processed.wav", rate: int = 16_000) -> DataFrame:
    """The same of the sound file called ``name`` of each recording below ``root``."""
    return _seconds(_workspace_files(spark, root, name), rate)


#: Rows of a matrix that are given on at once.
_ROWS = 4096


def _matrix(content: bytes) -> np.ndarray:
    """The matrix of a NumPy file: its header gives type, shape and order, and the numbers follow."""
    raw = io.BytesIO(content)
    version = np.lib.format.read_magic(raw)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(raw)
    if len(shape) != 2:
        raise ValueError(f"{len(shape)} dimensions")
    if kind.kind not in "fiub":
        raise ValueError(f"no numbers: {kind}")
    size = shape[0] * shape[1] * kind.itemsize
    if len(content) - raw.tell() < size:
        raise ValueError(f"{len(content) - raw.tell()} bytes of {size}")
    flat = np.frombuffer(content, kind, shape[0] * shape[1], raw.tell())
    return flat.reshape(shape[::-1]).T if by_column else flat.reshape(shape)


def matrices(spark: SparkSession, root: str, name: str = "text_embeddings.npy") -> DataFrame:
    """(video_id, id, embedding, problem): the rows of each recording's matrix, by number.

    A file that can't be read, isn't of two dimensions or holds no numbers gives one row with a ``problem`` and nothing else; a
    recording without the file, or with an empty file or matrix, gives no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for video, content in zip(pdf["video_id"], pdf["content"], strict=True):
                try:
                    x = _matrix(bytes(content))
                except (ValueError, EOFError, SyntaxError, TypeError) as e:
                    yield pd.DataFrame({"video_id": [video], "id": [None], "embedding": [None], "problem": [str(e) or "unreadable"]})
                    continue
                for s in range(0, len(x), _ROWS):
                    part = x[s : s + _ROWS].astype(np.float64)
                    yield pd.DataFrame({"video_id": video, "id": range(s, s + len(part)), "embedding": list(part), "problem": None})

    return _workspace_files(spark, root, name).mapInPandas(run, "video_id string, id int, embedding array<double>, problem string")


def write_documents(documents: DataFrame, path: str) -> None:
    """Writes (video_id, metadata) as one JSON line for each recording, in a folder for each; only these folders change."""
    rows = documents.select("video_id", F.to_json("metadata").alias("value"))
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("video_id").text(path)


def write_stage(table: DataFrame, path: str) -> None:
    """Writes a stage's table by recording; other recordings' rows stay."""
    table.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("video_id").parquet(path)


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stage's table, with the columns of ``schema``; an empty one where nothing has been stored yet."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts = jvm.org.apache.hadoop.fs.Path(f"{path}/video_id=*/*")
    if not parts.getFileSystem(conf).globStatus(parts):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)  # a declared schema keeps names like 007
