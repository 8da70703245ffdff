"""Queries of a review service over documents, and caches of finished work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(requested: DataFrame, finished: DataFrame, key: str = "video_id") -> DataFrame:
    """Requested rows without a finished result: what a cached stage has to compute."""
    return requested.join(finished.select(key), key, "left_anti")


def listed(files: DataFrame, documents: DataFrame, key: str = "video_id") -> DataFrame:
    """Files that have a document, with it."""
    return files.join(documents, key)


def found(documents: DataFrame, name: str, key: str = "video_id") -> DataFrame:
    """The document of one recording; no row where it has none. The filter reaches the scan of a table partitioned by ``key``."""
    return documents.filter(F.col(key) == name)


def replaced(documents: DataFrame, edited: DataFrame, key: str = "video_id") -> DataFrame:
    """Documents with the edited ones in place of the old, marked as verified; edits of unknown recordings are left out."""
    info = F.col("metadata.video_info").withField("verified_by_human", F.lit(True))
    new = edited.join(documents.select(key), key, "left_semi").withColumn("metadata", F.col("metadata").withField("video_info", info))
    return documents.join(edited.select(key), key, "left_anti").unionByName(new)


def relabelled(segments: Column, segment_id: Column, label: Column) -> Column:
    """An array of segments with one of them relabelled and marked as corrected."""
    return F.transform(segments, lambda s: F.when(s["segment_id"] == segment_id, s.withField("label", label).withField("user_corrected", F.lit(True))).otherwise(s))


def _on_timeline(now: DataFrame, segment: DataFrame, tolerance: float) -> DataFrame:
    """Moments and segments of each recording in one order of time; a moment stands after all that starts up to ``tolerance`` later."""
    moment = now.select("video_id", "now", (F.col("now") + tolerance).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(segment.select("seg").schema["seg"].dataType).alias("seg"))
    return moment.unionByName(segment.select("video_id", F.lit(None).cast("double").alias("now"), F.col("seg.start_sec").cast("double").alias("at"), F.lit(0).alias("kind"), "seg"))


def next_segment(now: DataFrame, segment: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """For each (video_id, now) the first segment that starts later than ``now`` + tolerance; one sort of each recording."""
    line = _on_timeline(now.distinct(), segment.select("video_id", F.struct("start_sec", "segment_id").alias("seg")), tolerance)
    after = Window.partitionBy("video_id").orderBy("at", "kind", "seg").rowsBetween(1, Window.unboundedFollowing)
    told = line.withColumn("next", F.first("seg", ignorenulls=True).over(after)).filter("kind = 1 and next is not null")
    return told.select("video_id", "now", F.col("next.start_sec").alias("start_sec"), F.col("next.segment_id").alias("segment_id"))


def skip_target(now: DataFrame, segment: DataFrame, step: float = 0.05) -> DataFrame:
    """For each (video_id, now) inside a segment that isn't core content, the place just after it; segments don't overlap."""
    line = _on_timeline(now.distinct(), segment.select("video_id", F.struct("start_sec", "end_sec", "label").alias("seg")), 0.0)
    before = Window.partitionBy("video_id").orderBy("at", "kind", "seg").rowsBetween(Window.unboundedPreceding, 0)
    told = line.withColumn("in", F.last("seg", ignorenulls=True).over(before)).filter("kind = 1 and now < in.end_sec and in.label <> 'core_content'")
    return told.select("video_id", "now", (F.col("in.end_sec") + step).alias("target"))


def _ranked(rows: DataFrame, key: str, part: Column, order: Column, weight: Column | None = None) -> DataFrame:
    """``rows`` with ``rank``: the sum of ``weight`` (1 where none is given) up to and with each row of its key, by part and then order.

    A key of very many rows is summed part by part; only its parts' totals meet in one place.
    """
    given = rows.withColumns({"_part": part, "_order": order, "_weight": F.lit(1) if weight is None else weight})
    totals = given.groupBy(key, "_part").agg(F.sum("_weight").alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(key, "_part", before.alias("_before"))
    within = F.sum("_weight").over(Window.partitionBy(key, "_part").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0))
    summed = given.withColumn("_within", within).join(offsets, [key, "_part"])
    return summed.withColumn("rank", F.col("_before") + F.col("_within")).drop("_part", "_order", "_weight", "_within", "_before")


def free_names(wanted: DataFrame, taken: DataFrame, parts: int = 256, width: int = 1 << 16) -> DataFrame:
    """(upload, stem, name) for each row of ``wanted`` (upload, stem): names that neither ``taken`` (name) nor another upload has.

    The first copy of a stem gets the stem itself if it is free, the k-th of the others the k-th of stem_2, stem_3, ... that is
    neither taken nor wanted as a stem. Copies are numbered by the hash of their upload in ``parts`` parts and then by upload, so a
    stem that most uploads share is spread out. A number n with i taken ones up to it leaves n - 1 - i free ones below, so
    the k-th free number is 1 + k and the count of taken ones with fewer than k free ones below them; nothing is enumerated. Names are
    compared whole: stem_02 is no number of stem. Null stems get null.
    """
    copies = _ranked(wanted.select("upload", "stem").filter("stem is not null"), "stem", F.pmod(F.xxhash64("upload"), F.lit(parts)), F.struct(F.col("upload").isNull(), "upload"))
    stems = wanted.select("stem").filter("stem is not null").distinct()
    names = taken.select("name").filter("name is not null").distinct()
    own = stems.join(names.withColumnRenamed("name", "stem"), "stem", "left_semi").withColumn("own", F.lit(1))
    number = F.expr("try_cast(regexp_extract(name, '_([1-9][0-9]{0,17})$', 1) as bigint)")
    blocked = names.union(stems.select(F.col("stem").alias("name"))).distinct()
    numbered = blocked.select(F.regexp_replace("name", "_[1-9][0-9]{0,17}$", "").alias("stem"), number.alias("n")).filter("n >= 2").join(stems, "stem", "left_semi")
    below = _ranked(numbered, "stem", F.floor(F.col("n") / width), F.col("n")).select("stem", (F.col("n") - 1 - F.col("rank")).alias("x"))
    gaps = below.groupBy("stem", "x").agg(F.count("*").alias("taken"))
    of_stem = copies.join(own, "stem", "left").withColumn("k", F.col("rank") - 1 + F.coalesce("own", F.lit(0)))
    both = of_stem.filter("k > 0").select("upload", "stem", (F.col("k") - 1).alias("x"), F.lit(0).cast("long").alias("taken"), F.lit(1).alias("kind"))
    both = both.union(gaps.select(F.lit(None).cast(wanted.schema["upload"].dataType), "stem", "x", "taken", F.lit(0)))
    counted = _ranked(both, "stem", F.floor(F.col("x") / width), F.struct("x", "kind", "upload"), F.col("taken")).filter("kind = 1")
    later = counted.select("upload", "stem", F.concat_ws("_", "stem", F.col("x") + 2 + F.col("rank")).alias("name"))
    first = of_stem.filter("k = 0").select("upload", "stem", F.col("stem").alias("name"))
    return first.union(later).union(wanted.filter("stem is null").select("upload", "stem", F.col("stem").alias("name")))


def job_status(events: DataFrame, now: Column) -> DataFrame:
    """(job_id, status, elapsed): the last state of each job of (job_id, ts, status, error) and its seconds since it began to run."""
    began, ended = F.min(F.when(F.col("status") == "running", F.col("ts"))), F.max(F.when(F.col("status").isin("done", "error"), F.col("ts")))
    jobs = events.groupBy("job_id").agg(F.max(F.struct("ts", "status")).alias("last"), began.alias("began"), ended.alias("ended"))
    return jobs.select("job_id", F.col("last.status").alias("status"), F.when(F.col("began").isNull(), 0.0).otherwise(F.round(F.coalesce("ended", now) - F.col("began"), 1)).alias("elapsed"))


def timeline_width(start: Column, end: Column, total: Column) -> Column:
    """A segment's share of the timeline in percent."""
    return F.when(total > 0, (end - start) / total * 100).otherwise(0.0)


def list_label(name: Column, duration: Column, verified: Column) -> Column:
    """A line of the recordings' list: name, seconds, and a check mark if verified."""
    return F.format_string("%s (%.1fs)%s", name, duration, F.when(verified, " ✓").otherwise(""))
