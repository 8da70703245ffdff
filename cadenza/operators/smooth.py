"""Smoothing of labelled segments: merging, absorbing, bridging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cadenza.config import DEFAULT, Config


def _by_start() -> WindowSpec:
    return Window.partitionBy("video_id").orderBy("start_sec", "segment_id")


FIELDS = ["segment_id", "start_sec", "end_sec", "label", "confidence", "visual_score", "audio_score", "text_score", "triggered_rules", "summary", "user_corrected"]


def _union_of_rules() -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list("triggered_rules"))))


def _merged(islands: DataFrame, label: Column, confidence: Column, rules: Column) -> DataFrame:
    """One segment for each island: the whole span, the best scores, the longest summary (of equals the first)."""
    single = F.count("*") == 1
    out = islands.groupBy("video_id", "island").agg(
        F.min(F.struct("start_sec", "segment_id", "label", "user_corrected")).alias("first"),
        F.max("end_sec").alias("end_sec"),
        label.alias("label"),
        confidence.alias("confidence"),
        *[F.max(c).alias(c) for c in ("visual_score", "audio_score", "text_score")],
        F.when(single, F.first("triggered_rules")).otherwise(rules).alias("triggered_rules"),
        F.max(F.struct(F.char_length("summary").alias("n"), (-F.col("start_sec")).alias("back"), "summary")).alias("s"),
        single.alias("single"),
    )
    return out.select(
        "video_id",
        F.col("first.segment_id").alias("segment_id"),
        F.col("first.start_sec").alias("start_sec"),
        "end_sec",
        F.coalesce("label", "first.label").alias("label"),
        "confidence",
        "visual_score",
        "audio_score",
        "text_score",
        "triggered_rules",
        F.col("s.summary").alias("summary"),
        (F.col("single") & F.col("first.user_corrected")).alias("user_corrected"),
    )


def merge_adjacent(segment: DataFrame) -> DataFrame:
    """Neighbours of one label become one segment."""
    new = F.coalesce((F.col("label") != F.lag("label").over(_by_start())).cast("int"), F.lit(1))
    islands = segment.withColumn("new", new).withColumn("island", F.sum("new").over(_by_start()))
    return _merged(islands, F.lit(None).cast("string"), F.max("confidence"), _union_of_rules())


def absorb_short(segment: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Segments that are too short go to the more confident neighbour (of equals the left one), which keeps all but its span.

    Nothing passes between two neighbours that are both long enough, so a recording falls apart into stretches at such places,
    and only stretches around short segments are folded, from left to right: what a short segment gives to its right
    neighbour is carried on. A stretch without short segments is a single segment and stays as it is.
    """
    item = F.struct(*FIELDS)
    enough = F.col("end_sec") - F.col("start_sec") >= config.min_segment
    new = F.coalesce((F.col("enough") & F.lag("enough").over(_by_start())).cast("int"), F.lit(1))
    apart = segment.withColumn("enough", enough).withColumn("new", new).withColumn("stretch", F.sum("new").over(_by_start()))
    rows = apart.select("video_id", "stretch", F.struct("start_sec", "segment_id", item.alias("s")).alias("r"))
    listed = rows.groupBy("video_id", "stretch").agg(F.array_sort(F.collect_list("r")).alias("r")).select("video_id", F.transform("r", lambda x: x["s"]).alias("s"))
    kind = item_type(segment)
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(None).cast("double").alias("carry"))

    def step(state: Column, i: Column) -> Column:
        s, out, n = F.get(F.col("s"), i), state["out"], F.size("s")
        begin = F.coalesce(state["carry"], s["start_sec"])
        last = F.get(out, F.size(out) - 1)
        short = (s["end_sec"] - begin < config.min_segment) & (n > 1)
        is_last = i == n - 1
        to_left = is_last | (last["confidence"] >= F.get(F.col("s"), i + 1)["confidence"])
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(last.withField("end_sec", s["end_sec"])))
        added = F.concat(out, F.array(s.withField("start_sec", begin)))
        none = F.lit(None).cast("double")
        empty = F.size(out) == 0
        return (
            F.when(short & empty & ~is_last, F.struct(out.alias("out"), begin.alias("carry")))
            .when(short & ~empty & to_left, F.struct(longer.alias("out"), none.alias("carry")))
            .when(short & ~empty, F.struct(out.alias("out"), begin.alias("carry")))
            .otherwise(F.struct(added.alias("out"), none.alias("carry")))
        )

    folded = listed.select("video_id", F.aggregate(F.sequence(F.lit(0), F.size("s") - 1), start, step)["out"].alias("out"))
    return folded.select("video_id", F.explode("out").alias("s")).select("video_id", *[F.col(f"s.{f}").alias(f) for f in FIELDS])


def item_type(segment: DataFrame) -> str:
    return "struct<" + ",".join(f"{f}:{segment.schema[f].dataType.simpleString()}" for f in FIELDS) + ">"


def bridge(segment: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A short segment between two sponsorships joins them, with the lesser of their confidences.

    Expects no neighbours of one label. Chains of bridges become one segment.
    """
    near = segment.withColumns({"before": F.lag("label").over(_by_start()), "after": F.lead("label").over(_by_start())})
    sponsored = F.col("label") == "sponsorship"
    is_bridge = ~sponsored & (F.col("before") == "sponsorship") & (F.col("after") == "sponsorship") & (F.col("end_sec") - F.col("start_sec") <= config.bridge)
    marked = near.withColumn("bridge", F.coalesce(is_bridge, F.lit(False)))
    joins = F.col("bridge") | F.coalesce(F.lag("bridge").over(_by_start()), F.lit(False))
    islands = marked.withColumn("new", (~joins).cast("int")).withColumn("island", F.sum("new").over(_by_start()))
    rules = F.array_sort(F.array_union(_union_of_rules(), F.array(F.lit("sponsorship_bridge"))))
    flanks = F.coalesce(F.min(F.when(sponsored, F.col("confidence"))), F.max("confidence"))
    return _merged(islands, F.lit(None).cast("string"), flanks, rules)


def renumber(segment: DataFrame) -> DataFrame:
    return segment.withColumn("segment_id", F.row_number().over(_by_start()) - 1)


def smooth(segment: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Merge, absorb, merge, bridge, number anew; bridging leaves no neighbours of one label, so nothing is left to merge."""
    return renumber(bridge(merge_adjacent(absorb_short(merge_adjacent(segment), config)), config))
