"""Tables written once to the shared checkpoint folder, so that later steps neither recompute nor lose them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset on a single machine (as in tests), a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Python workers get batches of at most 16 MB, as rows may be very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cadenza-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` returned and nothing needs any longer."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
