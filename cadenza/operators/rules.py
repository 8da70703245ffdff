"""Hard rules: intervals with a label, a rule name and a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Config
from cadenza.functions.expressions import first_match
from cadenza.operators.runs import runs

COLUMNS = ["video_id", "start_sec", "end_sec", "label", "rule_name", "confidence", "ord"]


def _hits(df: DataFrame, label: str, name: Column, confidence: float, order: Column) -> DataFrame:
    return df.select("video_id", F.col("start_sec").cast("int").alias("start_sec"), F.col("end_sec").cast("int").alias("end_sec"), F.lit(label).alias("label"), name.alias("rule_name"), F.lit(confidence).alias("confidence"), order.cast("long").alias("ord"))


def dead_air(grid: DataFrame, config: Config = DEFAULT) -> DataFrame:
    quiet = (F.col("is_speech") == 0) & (F.coalesce("rms_energy", F.lit(0.0)) < config.dead_air_rms)
    return _hits(runs(grid, quiet, config.dead_air_run), "dead_air", F.lit("dead_air"), 0.9, F.col("start_sec"))


def ad_break(grid: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return _hits(runs(grid, F.col("is_speech") == 0, config.ad_run, config.ad_gap), "sponsorship", F.lit("ad_break"), 0.85, F.col("start_sec"))


def holding_screen(grid: DataFrame, config: Config = DEFAULT) -> DataFrame:
    still = (F.col("hist_diff") < config.holding_diff) & (F.col("is_speech") == 0)
    return _hits(runs(grid, still, config.holding_run), "holding_screen", F.lit("holding_screen"), 0.7, F.col("start_sec"))


def _with_seconds(grid: DataFrame, text: DataFrame) -> DataFrame:
    """Sentences with the length of their recording's grid; ``grid`` may be (video_id, seconds) at once."""
    if "seconds" in grid.columns:
        return text.join(grid.select("video_id", "seconds"), "video_id")
    return text.join(grid.groupBy("video_id").agg((F.max("t") + 1).alias("seconds")), "video_id")


def _window(grid: DataFrame, text: DataFrame, group: str, label: str, before: int, after: int, confidence: float) -> DataFrame:
    match = first_match(F.col("matched_keywords"), group)
    found = _with_seconds(grid, text).withColumn("match", match).filter("match is not null")
    found = found.withColumns({"start_sec": F.greatest(F.lit(0), F.floor(F.col("start") - before)), "end_sec": F.least(F.col("seconds"), F.ceil(F.col("end") + after))})
    return _hits(found, label, F.col("match"), confidence, F.col("pos"))


def sponsor_keywords(grid: DataFrame, text: DataFrame) -> DataFrame:
    return _window(grid, text, "sponsor", "sponsorship", 15, 15, 0.85)


def self_promo_keywords(grid: DataFrame, text: DataFrame) -> DataFrame:
    return _window(grid, text, "self_promo", "self_promotion", 5, 5, 0.75)


def recap_keywords(grid: DataFrame, text: DataFrame) -> DataFrame:
    return _window(grid, text, "recap", "recap", 5, 30, 0.7)


def intro_keyword(grid: DataFrame, text: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The first intro phrase before any sentence starts late: from 0 to ten seconds after it."""
    up_to = Window.partitionBy("video_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    early = text.withColumn("late", F.max(F.col("start") > config.intro_window).over(up_to)).filter("not late")
    matched = early.withColumn("match", first_match(F.col("matched_keywords"), "intro")).filter("match is not null")
    first = matched.groupBy("video_id").agg(F.min(F.struct("pos", "end", "match")).alias("m")).select("video_id", "m.*")
    found = _with_seconds(grid, first).withColumns({"start_sec": F.lit(0), "end_sec": F.least(F.col("seconds"), F.ceil(F.col("end") + 10))})
    return _hits(found, "intro", F.col("match"), 0.7, F.col("pos"))


def outro_keyword(grid: DataFrame, text: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The first outro phrase in the last seconds: from five seconds before it to the end."""
    late = _with_seconds(grid, text).filter(F.col("end") >= F.greatest(F.lit(0), F.col("seconds") - config.outro_window))
    matched = late.withColumn("match", first_match(F.col("matched_keywords"), "outro")).filter("match is not null")
    first = matched.groupBy("video_id").agg(F.min(F.struct("pos", "start", "match", "seconds")).alias("m")).select("video_id", "m.*")
    found = first.withColumns({"start_sec": F.greatest(F.lit(0), F.floor(F.col("start") - 5)), "end_sec": F.col("seconds")})
    return _hits(found, "outro", F.col("match"), 0.8, F.col("pos"))


def all_rules(grid: DataFrame, text: DataFrame, config: Config = DEFAULT, ends: DataFrame | None = None) -> DataFrame:
    """All hits, overlaps kept, with hit_ord: the order of the rules, and within a rule the order of time or sentences.

    ``ends`` (video_id, seconds) spares the keyword rules a pass each over the grid.
    """
    length = grid if ends is None else ends
    parts = [
        dead_air(grid, config),
        holding_screen(grid, config),
        sponsor_keywords(length, text),
        self_promo_keywords(length, text),
        recap_keywords(length, text),
        intro_keyword(length, text, config),
        outro_keyword(length, text, config),
        ad_break(grid, config),
    ]
    ranked = [p.withColumn("rule_rank", F.lit(k)) for k, p in enumerate(parts)]
    every = ranked[0]
    for p in ranked[1:]:
        every = every.unionByName(p)
    order = F.row_number().over(Window.partitionBy("video_id").orderBy("rule_rank", "ord"))
    return every.select("video_id", order.alias("hit_ord"), *COLUMNS[1:-1])
