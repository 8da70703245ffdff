"""Uploads as a stream: files that land in a folder become rows of a table, each once, and those that are no recordings are kept with the reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cadenza.functions.expressions import safe_stem
from cadenza.operators.review import free_names

FILE = "path string, modificationTime timestamp, length long, content binary"
LANDED = "path string, name string, bytes long, modified timestamp, reason string, batch long"


def uploads(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """(path, bytes, modified) of the files of ``folder`` as they come; their contents aren't read."""
    found = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_at_once).load(folder)
    return found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def _empty(spark: SparkSession, folder: str) -> DataFrame:
    """The files of ``folder`` without content, which no scan gives."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    rows = [(str(s.getPath()), s.getModificationTime()) for s in listed if s.isFile() and s.getLen() == 0 and not s.getPath().getName().startswith((".", "_"))]
    found = spark.createDataFrame(rows, "path string, ms long")
    return found.select("path", F.lit(0).cast("long").alias("bytes"), F.timestamp_millis("ms").alias("modified"))


def landed(spark: SparkSession, target: str) -> DataFrame:
    """The table of all uploads so far: accepted ones with a name, the others with a reason."""
    parts = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/batch=*/*.parquet")
    schema = StructType.fromDDL(LANDED)
    if not parts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(parts):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(target).select(*schema.names)


def judged(files: DataFrame, taken: DataFrame) -> DataFrame:
    """``files`` (path, bytes, modified) with a free name each, or the reason why they are refused.

    Only files with the ending .mp4, in any case, and content are recordings; names are the files' cleaned stems, numbered
    where ``taken`` (name) or another file has them.
    """
    file = F.regexp_extract("path", r"([^/]*)$", 1)
    reason = F.when(~F.lower(file).endswith(".mp4"), "not an MP4 file").when(F.col("bytes") == 0, "empty")
    told = files.withColumns({"reason": reason, "stem": safe_stem(file)})
    names = free_names(told.filter("reason is null").select(F.col("path").alias("upload"), "stem"), taken).select(F.col("upload").alias("path"), "name")
    return told.join(names, "path", "left").select("path", "name", "bytes", "modified", "reason")


def land(files: DataFrame, folder: str, target: str, checkpoint: str, *, after_write: Callable[[int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Starts the stream of ``uploads`` into the table at ``target``.

    A batch is one partition of the table, written by Spark's commit protocol and in place of what an earlier attempt at the
    same batch has left; names depend on earlier batches alone. So a batch that is repeated, because the job ended between
    writing and noting it, leaves neither half files nor doubles. ``after_write`` is called with the batch's number in between.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before = landed(spark, target).filter(F.col("batch") < number)
        empty = _empty(spark, folder).join(before.select("path"), "path", "left_anti")
        told = judged(rows.select("path", "bytes", "modified").unionByName(empty), before.filter("name is not null").select("name"))
        out = told.withColumn("batch", F.lit(number).cast("long"))
        out.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch").parquet(target)
        if after_write is not None:
            after_write(number)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
