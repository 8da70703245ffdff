"""Tables that are replaced as a whole: written beside the old one, checked, and swapped, with recovery of a broken swap.

Beside a table at ``x`` stand, while it is replaced, ``x.new`` (being written, or checked if it holds the file _CHECKED) and, for
the moment of the swap, ``x.old``. A reader sees the old table or the new one; only between two renames it sees none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_CHECKED = "_CHECKED"


class _Folder:
    """The three places of a table in any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.table, self.new, self.old = path, f"{path}.new", f"{path}.old"

    def there(self, at: str) -> bool:
        return self.system.exists(self.path(at))

    def delete(self, at: str) -> None:
        self.system.delete(self.path(at), True)

    def rename(self, source: str, target: str) -> None:
        if not self.system.rename(self.path(source), self.path(target)):
            raise OSError(f"{source} can't be renamed to {target}")

    def touch(self, at: str) -> None:
        self.system.create(self.path(at), True).close()


def recover(spark: SparkSession, path: str) -> str:
    """Brings a table that a job has left in the middle of a replacement into order, and tells how.

    A new table that was checked takes the place of the old one; one that wasn't is dropped.
    """
    f = _Folder(spark, path)
    checked = f.there(f"{f.new}/{_CHECKED}")
    if not f.there(f.table):
        if checked:
            f.rename(f.new, f.table)
            f.delete(f.old)
            return "new"
        if f.there(f.old):
            f.rename(f.old, f.table)
            f.delete(f.new)
            return "old"
        f.delete(f.new)
        return "none"
    if checked:
        _swap(f)
        return "new"
    left = f.there(f.new) or f.there(f.old)
    f.delete(f.new)
    f.delete(f.old)
    return "dropped" if left else "in order"


def _swap(f: _Folder) -> None:
    f.delete(f.old)
    if f.there(f.table):
        f.rename(f.table, f.old)
    f.rename(f.new, f.table)
    f.delete(f.old)


def replace_table(df: DataFrame, path: str, check: Callable[[DataFrame], bool] | None = None) -> None:
    """Puts ``df`` as Parquet in the place of the table at ``path``, which it may have been read from.

    ``check`` gets the new table as it was written; if it says no, ``ValueError`` is raised and the old table stays. A
    failure at any point leaves a state that ``recover``, called here first, brings into order. One job at a time may replace a table.
    """
    spark = df.sparkSession
    recover(spark, path)
    f = _Folder(spark, path)
    df.write.mode("overwrite").parquet(f.new)
    if check is not None and not check(spark.read.schema(df.schema).parquet(f.new)):
        f.delete(f.new)
        raise ValueError(f"the new table for {path} was refused")
    f.touch(f"{f.new}/{_CHECKED}")
    _swap(f)
