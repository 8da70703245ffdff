"""Segments recordings from files: ``python -m cadenza WORKSPACES OUTPUT``, or by spark-submit.

WORKSPACES holds a folder for each recording with meta_raw.json and visual_features.json, and audio_features.json or, with
--features, the sound itself in audio_processed.wav; where the recording is spoken, transcript.json, text_features.json and the
sentences' vectors in text_embeddings.npy, all in it or in folders of it. OUTPUT gets one document for each recording.
With --features FOLDER sound and text features that are missing are worked out first and kept there; those that are there
already are worked out again only with --force.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza import schemas
from cadenza.plans import features as extract
from cadenza.plans.fusion import Fusion
from cadenza.sources import files


def _each(documents: DataFrame, column: str) -> DataFrame:
    return documents.select("video_id", F.posexplode(column).alias("pos", "r")).select("video_id", "pos", "r.*")


def _stage(spark: SparkSession, path: str, wanted: DataFrame, force: bool) -> DataFrame:
    """What the stage's table at ``path`` has, with the rows of ``wanted`` for recordings that it lacks (or for all, with ``force``)."""
    if not force:
        wanted = wanted.join(files.stored(spark, path, wanted.schema).select("video_id").distinct(), "video_id", "left_anti").select(*wanted.columns)
    files.write_stage(wanted, path)
    return files.stored(spark, path, wanted.schema)


def extracted(spark: SparkSession, root: str, features: str, force: bool) -> tuple[DataFrame, DataFrame]:
    """Sound and text features of the recordings below ``root`` that come without, from the tables at ``features``."""
    speech = _each(files.workspace_documents(spark, root, "speech.json", schemas.SPEECH), "segments")
    chunks = files.workspace_chunks(spark, root)
    known = [extract.sound(chunks.join(speech, "video_id", "left_semi"), speech), extract.sound(chunks.join(speech, "video_id", "left_anti"))]
    told = _each(files.workspace_documents(spark, root, "transcript.json", schemas.TRANSCRIPT), "segments")
    vectors = files.matrices(spark, root).filter("problem is null")
    audio = _stage(spark, f"{features}/audio_features", known[0].unionByName(known[1]), force)
    return audio, _stage(spark, f"{features}/text_features", extract.text(told, vectors), force)


def segmented(spark: SparkSession, root: str, output: str, features: str | None = None, force: bool = False) -> bool:
    """Writes the documents of all recordings below ``root`` whose inputs are complete; false where no recording has them.

    A recording without text is segmented by sound and pictures alone. Summaries and titles are chosen from the transcript, or
    from the text features of a recording without one, by the sentences' vectors; where there are none, or they can't be read,
    the longest sentence is taken.
    """

    def each(name: str, schema: str, column: str) -> DataFrame:
        return _each(files.workspace_documents(spark, root, name, schema), column)

    def both(given: DataFrame, more: DataFrame) -> DataFrame:
        """``given``, and of recordings that it lacks what ``more`` has."""
        return given.unionByName(more.join(given.select("video_id").distinct(), "video_id", "left_anti").select(*given.columns))

    audio, visual = each("audio_features.json", schemas.AUDIO_FEATURES, "segments"), each("visual_features.json", schemas.VISUAL_FEATURES, "frames")
    text, transcript = each("text_features.json", schemas.TEXT_FEATURES, "segments"), each("transcript.json", schemas.TRANSCRIPT, "segments")
    if features is not None:
        more_audio, more_text = extracted(spark, root, features, force)
        audio, text = both(audio, more_audio), both(text, more_text)
    meta = files.workspace_documents(spark, root, "meta_raw.json", schemas.META_RAW)
    whole = meta.join(audio.select("video_id").distinct(), "video_id", "left_semi").join(visual.select("video_id").distinct(), "video_id", "left_semi")
    if whole.isEmpty():
        return False
    read = files.matrices(spark, root)
    for row in read.filter("problem is not null").select("video_id", "problem").limit(100).collect():
        print(f"{row['video_id']}: vectors left out, {row['problem']}", file=sys.stderr)
    sentences = both(transcript, text.select(*transcript.columns))
    vectors = read.filter("problem is null").select("video_id", "id", "embedding")
    fusion = Fusion(whole.select("video_id", "duration_sec"), audio, visual, text, vectors, transcript=sentences)
    files.write_documents(fusion.documents(whole.select("video_id", "filename", "duration_sec", "fps", "width", "height")), output)
    for stage, told in fusion.measures.items():
        print(f"{stage}: {', '.join(f'{k} {v}' for k, v in told.items())}", file=sys.stderr)
    return True


def main() -> int:
    parser = argparse.ArgumentParser(prog="cadenza", description=__doc__)
    parser.add_argument("workspaces")
    parser.add_argument("output")
    parser.add_argument("--features", metavar="FOLDER", help="work out missing sound and text features, and keep them here")
    parser.add_argument("--force", action="store_true", help="work out all features again")
    given = parser.parse_args()
    # files are rows here, so batches are bounded by bytes
    spark = SparkSession.builder.appName("cadenza").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.maxBytesPerBatch", "64m").getOrCreate()
    if not segmented(spark, given.workspaces, given.output, given.features, given.force):
        print(f"no recording below {given.workspaces} has meta_raw.json and the features of sound and pictures", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
