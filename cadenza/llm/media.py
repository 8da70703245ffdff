"""Media columns: texts stored losslessly as progressive JPEG pictures, and read back as payloads and RGB tensors (operator 10)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import jpeg
from cadenza.llm.lineage import bounded_batches

UNIT = 64


def padded(raw: bytes) -> bytes:
    """``raw`` and bytes 0 up to a positive multiple of UNIT."""
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def store_as_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes and media, the picture that holds the whole text.

    A null or empty text is stored as one unit of zeros. Ids may be null or repeat: one row comes out for each row in.
    Other columns are not read. Equal texts give equal pictures.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 256):
                part = pdf.iloc[start : start + 256]
                raw = [t.encode() for t in part["text"].tolist()]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n_bytes": [len(r) for r in raw], "media": [jpeg.encode(padded(r)) for r in raw]})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, n_bytes long, media binary").select(F.col("id").alias(id_col), "n_bytes", "media")


def feature(picture: jpeg.Image) -> str:
    """Height x width and the mean of each RGB channel."""
    rgb = picture.rgb()
    means = rgb.reshape(-1, 3).mean(axis=0, dtype=float)
    return f"{picture.height}x{picture.width}:" + ",".join(f"{m:.2f}" for m in means)


def read_media(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", with_tensors: bool = True) -> DataFrame:
    """Decodes pictures: ``id_col``, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and, with
    ``with_tensors``, height, width and rgb (height x width x 3 unsigned bytes, row by row).

    Any progressive JPEG is decoded; payload columns are null where a picture holds no payload, and all but the media
    columns are null where the bytes are null or no progressive JPEG.
    """
    bounded_batches(media.sparkSession)
    kind = media.schema[id_col].dataType.simpleString()

    def row(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * 9
        stored = (len(raw), hashlib.sha256(raw).hexdigest())
        try:
            picture = jpeg.decode(raw)
        except (ValueError, KeyError, IndexError):
            return (None, None, None, *stored, None, None, None, None)
        try:
            held = jpeg.payload(picture)
            told = (len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-UNIT:]))
        except ValueError:
            told = (None, None, None)
        tensor = (picture.height, picture.width, picture.rgb().tobytes()) if with_tensors else (None, None, None)
        return (*told, *stored, feature(picture), *tensor)

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "rgb"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 256):
                part = pdf.iloc[start : start + 256]
                out = pd.DataFrame([row(raw) for raw in part["media"].tolist()], columns=names)
                out.insert(0, "id", part["id"].to_numpy())
                yield out

    schema = f"id {kind}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb binary"
    out = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInPandas(run, schema)
    return out.select(F.col("id").alias(id_col), *(names if with_tensors else names[:6]))
