"""Segments between boundaries: what they hold, which rule covers them, and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Config
from cadenza.functions.expressions import overlap_seconds, scene_label, strip
from cadenza.operators.align import until
from cadenza.operators.overlap import meeting

KEY = ["video_id", "segment_id"]
MEANS = ["is_speech", "rms_energy", "is_music", "hist_diff", "is_hard_cut", "has_text"]


def segments(bounds: DataFrame) -> DataFrame:
    """(video_id, segment_id, start_sec, end_sec) of (video_id, boundaries); empty intervals keep their number and go."""
    n = F.greatest(F.size("boundaries") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("boundaries", 1, n).alias("s"), F.slice("boundaries", 2, n).alias("e"))
    rows = bounds.select("video_id", F.posexplode(pairs).alias("segment_id", "p"))
    return rows.select("video_id", "segment_id", F.col("p.s").alias("start_sec"), F.col("p.e").alias("end_sec")).filter("end_sec > start_sec")


def inside(grid: DataFrame, segment: DataFrame) -> DataFrame:
    """Seconds of ``grid``, or parts of its stretches of them, with the segment that holds them (its number, start and end) and
    ``n``, how many seconds they are; segments of a recording don't overlap.

    Starts of segments stand among the rows in the order of time. The last start and the last row of the grid before a place
    hold up to the next place, or to their own end.
    """
    starts = segment.select("video_id", F.col("start_sec").alias("t"), F.struct("segment_id", "start_sec", "end_sec").alias("seg"))
    own = [c for c in grid.columns if c not in ("video_id", "t", "until")]
    rows = grid.select("video_id", "t", F.struct(until(grid).alias("until"), *own).alias("row"))
    line = rows.unionByName(starts, allowMissingColumns=True)
    by_time = Window.partitionBy("video_id").orderBy("t", F.col("row").isNotNull())
    up_to = by_time.rowsBetween(Window.unboundedPreceding, 0)
    held = line.select("video_id", "t", *[F.last(c, ignorenulls=True).over(up_to).alias(c) for c in ("seg", "row")], F.lead("t").over(by_time).alias("next")).filter("seg is not null and row is not null")
    end = F.least("next", "row.until", "seg.end_sec")
    parts = held.select("video_id", "seg.segment_id", "seg.start_sec", "seg.end_sec", "t", (end - F.col("t")).cast("int").alias("n"), *[F.col(f"row.{c}").alias(c) for c in own])
    return parts.filter("n > 0")


def mean(value: Column) -> Column:
    """The mean of a value over the seconds of rows of ``inside``; of those for which it is known."""
    return F.sum(value.cast("double") * F.col("n")) / F.sum(F.when(value.isNotNull(), F.col("n")))


def _means(grid: DataFrame) -> list[Column]:
    means = [mean(F.col(c)).alias(c) for c in MEANS if c in grid.columns]
    return [*means, F.coalesce(mean(F.col("text_sim_to_next")), F.lit(0.0)).alias("text_sim_to_next")]


def segment_means(grid: DataFrame, segment: DataFrame) -> DataFrame:
    """Means of all grid columns by segment; of the similarity only where it is known, 0 where it never is."""
    return inside(grid, segment).groupBy(*KEY).agg(*_means(grid))


def scenes_of(grid: DataFrame) -> int:
    """How many scenes the longest vector of ``grid`` has; a pass over it."""
    return max(grid.agg(F.max(F.size("scene"))).first()[0] or 0, 0)


def _probs(scenes: int) -> Column:
    """The mean probability of each scene, as long as the longest vector of the group: sums side by side, so no second becomes a row for each scene."""
    means = F.array(*[mean(F.get("scene", F.lit(k))) for k in range(scenes)]).cast("array<double>")
    return F.slice(means, F.lit(1), F.coalesce(F.greatest(F.max(F.size("scene")), F.lit(0)), F.lit(0)))


def scene_means(grid: DataFrame, segment: DataFrame, scenes: int | None = None) -> DataFrame:
    """(video_id, segment_id, probs): mean probability of each scene label by segment, in label order.

    ``scenes`` is the length of the longest scene vector; where it isn't given, ``scenes_of`` finds it.
    """
    scenes = scenes_of(grid) if scenes is None else scenes
    return inside(grid.select("video_id", "t", until(grid).alias("until"), "scene"), segment).groupBy(*KEY).agg(_probs(scenes).alias("probs")).filter(F.size("probs") > 0)


def _likeliest() -> Column:
    return F.array_max(F.transform("probs", lambda p, k: F.when(p.isNotNull(), F.struct(F.round(p, 9).alias("prob"), (-k).alias("back")))))


def _with_scene(means: DataFrame, labels: DataFrame, how: str) -> DataFrame:
    top = means.withColumn("m", _likeliest()).join(labels, "video_id", how)
    return top.withColumns({"prob": F.col("m.prob"), "scene": F.get("labels", -F.col("m.back"))}).drop("probs", "m", "labels")


def best_scene(means: DataFrame, labels: DataFrame) -> DataFrame:
    """(video_id, segment_id, prob, scene): the likeliest scene label, of equals the first."""
    return _with_scene(means, labels, "inner")


def profile(grid: DataFrame, segment: DataFrame, labels: DataFrame, scenes: int | None = None) -> DataFrame:
    """``segment_means`` and ``best_scene`` with the segments' spans in one pass over the seconds; prob and scene are null where nothing is seen."""
    scenes = scenes_of(grid) if scenes is None else scenes
    span = [F.first(c).alias(c) for c in ("start_sec", "end_sec")]
    return _with_scene(inside(grid, segment).groupBy(*KEY).agg(*span, *_means(grid), _probs(scenes).alias("probs")), labels, "left")


def rule_coverage(segment: DataFrame, hits: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The rules that cover enough of each segment: the most confident one's label (of equals the first), and all names in order."""
    other = hits.select("video_id", F.col("start_sec").alias("hs"), F.col("end_sec").alias("he"), "hit_ord", "label", "rule_name", "confidence")
    pairs = meeting(segment, ("start_sec", "end_sec"), other, ("hs", "he"))
    share = overlap_seconds(F.col("start_sec"), F.col("end_sec"), F.col("hs"), F.col("he")) / F.greatest(F.lit(1), F.col("end_sec") - F.col("start_sec"))
    covering = pairs.filter((F.col("hs") < F.col("end_sec")) & (F.col("he") > F.col("start_sec"))).filter(share >= config.coverage)
    best = F.max(F.struct("confidence", (-F.col("hit_ord")).alias("back"), "label"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("hit_ord", "rule_name"))), lambda x: x["rule_name"])
    out = covering.groupBy(*KEY).agg(best.alias("b"), names.alias("rules"))
    return out.select(*KEY, F.col("b.label").alias("label"), F.col("b.confidence").alias("confidence"), "rules")


def longest_sentence(segment: DataFrame, sentences: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(video_id, segment_id, summary): the longest sentence within the segment, else the longest that overlaps it."""
    inside = (F.col("start") >= F.col("start_sec")) & (F.col("end") <= F.col("end_sec"))
    touching = (F.col("end") > F.col("start_sec")) & (F.col("start") < F.col("end_sec"))
    told = sentences.select("video_id", "pos", "start", "end", "text")
    pairs = meeting(segment, ("start_sec", "end_sec"), told, ("start", "end")).filter(inside | touching)
    best = pairs.groupBy(*KEY).agg(F.max(F.struct(inside.alias("inside"), F.char_length("text").alias("n"), (-F.col("pos")).alias("back"), "text")).alias("m"))
    return best.select(*KEY, F.left(strip(F.col("m.text")), F.lit(config.summary_chars)).alias("summary"))


def classify(grid: DataFrame, bounds: DataFrame, hits: DataFrame, sentences: DataFrame, labels: DataFrame, config: Config = DEFAULT, scenes: int | None = None) -> DataFrame:
    """Labelled segments with evidence: a covering rule decides, else the likeliest scene and the speech."""
    seg = segments(bounds)
    joined = (
        profile(grid, seg, labels, scenes)
        .join(rule_coverage(seg, hits, config).withColumnsRenamed({"label": "rule_label", "confidence": "rule_confidence"}), KEY, "left")
        .join(longest_sentence(seg, sentences, config), KEY, "left")
    )
    mapped = scene_label(F.col("scene"), config)
    quiet = (F.col("is_speech") < config.little_speech) & (mapped == "core_content")
    by_scene = F.when(F.col("scene").isNull(), "core_content").when(quiet, "filler").otherwise(mapped)
    has_rule, no_scene = F.col("rule_label").isNotNull(), F.col("scene").isNull()
    guess = F.when(no_scene, 0.3).otherwise((F.col("prob") + F.col("is_speech") + F.col("has_text")) / 3.0)
    bare = no_scene & ~has_rule  # nothing seen and no rule: no evidence at all
    scores = [F.when(bare, 0.0).otherwise(F.round(F.coalesce(c, F.lit(0.0)), 3)).alias(n) for n, c in (("visual_score", F.col("prob")), ("audio_score", F.col("is_speech")), ("text_score", F.col("has_text")))]
    return joined.select(
        *KEY,
        F.col("start_sec").cast("double").alias("start_sec"),
        F.col("end_sec").cast("double").alias("end_sec"),
        F.coalesce("rule_label", by_scene).alias("label"),
        F.round(F.coalesce("rule_confidence", guess), 3).alias("confidence"),
        *scores,
        F.coalesce("rules", F.array().cast("array<string>")).alias("triggered_rules"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.lit(False).alias("user_corrected"),
    )
