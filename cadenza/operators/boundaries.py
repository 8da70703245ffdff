"""Candidate boundaries and their greedy thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cadenza.config import DEFAULT, Config
from cadenza.functions.expressions import scene_divergence
from cadenza.operators.align import until


def _by_time() -> WindowSpec:
    return Window.partitionBy("video_id").orderBy("t")


def scene_shifts(grid: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(video_id, t, divergence): seconds whose scene differs from the one before."""
    before = grid.select("video_id", "t", "scene", F.lag("scene").over(_by_time()).alias("before"))
    told = before.filter("before is not null and size(scene) > 0 and scene <> before").withColumn("divergence", scene_divergence(F.col("before"), F.col("scene")))
    return told.filter(F.col("divergence") > config.scene_shift).select("video_id", "t", "divergence")


def flips(grid: DataFrame, column: str) -> DataFrame:
    """(video_id, t): seconds where a flag differs from the second before."""
    return grid.select("video_id", "t", column, F.lag(column).over(_by_time()).alias("before")).filter(F.col("before") != F.col(column)).select("video_id", "t")


def hard_cuts(grid: DataFrame) -> DataFrame:
    return grid.filter("is_hard_cut = 1").select("video_id", "t")


def low_similarity(grid: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(video_id, t): the second after each second of low similarity."""
    return grid.filter(F.col("text_sim_to_next") < config.similarity).select("video_id", (F.col("t") + 1).alias("t"))


#: Vectors of more scenes than this are compared by functions of their components, which are no generated code.
SIDE_BY_SIDE = 64


def _shares(grid: DataFrame, scenes: int) -> DataFrame:
    """``grid`` with the components of ``scene``, clipped and scaled as in ``scene_divergence``, as columns ``_share``k; null where it has fewer."""
    has = [F.size("scene") > k for k in range(scenes)]
    clipped = {f"_clip{k}": F.when(has[k], F.greatest(F.lit(1e-9), F.least(F.lit(1.0), F.get("scene", F.lit(k))))).otherwise(0.0) for k in range(scenes)}
    summed = grid.withColumns(clipped).withColumn("_sum", sum((F.col(c) for c in clipped), F.lit(0.0)))
    return summed.withColumns({f"_share{k}": F.when(has[k], F.col(f"_clip{k}") / F.col("_sum")) for k in range(scenes)}).drop("_sum", *clipped)


def _divergence(scenes: int) -> Column:
    """``scene_divergence`` of the vector before and this one, out of ``_shares`` of both; the same terms in the same order."""
    out = F.lit(0.0)
    for k in range(scenes):
        a, b = F.col(f"_share{k}_before"), F.col(f"_share{k}")
        out = out + F.when(F.size("scene") > k, 0.5 * (a - b) * F.log(a / b)).otherwise(0.0)
    return F.when(F.size("scene_before") == F.size("scene"), out)


def candidates(grid: DataFrame, config: Config = DEFAULT, scenes: int | None = None) -> DataFrame:
    """(video_id, t), distinct: cuts, shifts, flips, low similarities, and both ends.

    One pass over a single window: what every row tells is an array, exploded afterwards. A row is a second or a stretch of equal ones,
    in which nothing changes but every second may have a cut or a low similarity. Where ``scenes`` tells how long the longest scene
    vector is, components are compared side by side.
    """
    flat = scenes is not None and scenes <= SIDE_BY_SIDE
    shares = [f"_share{k}" for k in range(scenes)] if flat else []
    rows = _shares(grid, scenes) if flat else grid
    g = rows.select("*", *[F.lag(c).over(_by_time()).alias(f"{c}_before") for c in ("scene", "is_speech", "is_music", *shares)], F.lead("t").over(_by_time()).isNull().alias("is_last"))
    divergence = _divergence(scenes) if flat else scene_divergence(F.col("scene_before"), F.col("scene"))
    t, end = F.col("t"), until(grid)
    moved = F.when(F.col("scene_before").isNotNull() & (F.size("scene") > 0) & (F.col("scene") != F.col("scene_before")), divergence > config.scene_shift)
    here = F.coalesce(moved, F.lit(False)) | F.coalesce(F.col("is_speech_before") != F.col("is_speech"), F.lit(False)) | F.coalesce(F.col("is_music_before") != F.col("is_music"), F.lit(False))
    none = F.array().cast("array<int>")
    told = F.concat(
        F.when(F.col("is_hard_cut") == 1, F.sequence(t, end - 1)).when(here | (t == 0), F.array(t)).otherwise(none),
        F.when(F.col("text_sim_to_next") < config.similarity, F.sequence(t + 1, end)).otherwise(none),
        F.when(F.col("is_last"), F.array(end)).otherwise(none),
    )
    return g.select("video_id", F.explode(told).alias("t")).distinct()


def boundaries(candidate: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(video_id, boundaries): kept if far enough from the last kept one, the last candidate always.

    A candidate that is far enough from the one before it is far enough from the last kept one too, so it is kept whatever
    came before, and a recording falls apart into stretches that begin with such candidates and don't depend on each other.
    Within one, seconds are written as a string, 1 for a candidate: matches of a candidate and the seconds that are too near
    after it, taken from the left without overlap, begin at the candidates that are kept. So all steps are linear. A stretch
    shorter than the least distance keeps its first candidate alone, without any string.
    """
    by_time = Window.partitionBy("video_id").orderBy("t")
    new = F.coalesce((F.col("t") - F.lag("t").over(by_time) >= config.min_gap).cast("int"), F.lit(1))
    stretches = candidate.select("video_id", "t").distinct().withColumn("new", new).withColumn("stretch", F.sum("new").over(by_time))
    listed = stretches.groupBy("video_id", "stretch").agg(F.array_sort(F.collect_list("t")).alias("c"))
    before = lambda i: F.coalesce(F.get("c", i - 1), F.element_at("c", 1) - 1)
    marks = F.array_join(F.transform("c", lambda t, i: F.concat(F.repeat(F.lit("0"), t - before(i) - 1), F.lit("1"))), "")
    chosen = F.split(F.regexp_replace(marks, f"1(.{{0,{max(config.min_gap - 1, 0)}}})", "K$1"), "")
    kept = F.filter(F.transform(chosen, lambda x, i: F.when(x == "K", F.element_at("c", 1) + i)), lambda t: t.isNotNull())
    brief = F.element_at("c", -1) - F.element_at("c", 1) < F.greatest(F.lit(config.min_gap), F.lit(1))
    thinned = listed.select("video_id", "stretch", F.when(brief, F.slice("c", 1, 1)).otherwise(kept).alias("kept"), F.element_at("c", -1).alias("last"))
    whole = thinned.groupBy("video_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "kept"))), lambda x: x["kept"])).alias("kept"), F.max("last").alias("last"))
    return whole.select("video_id", F.when(F.element_at("kept", -1) == F.col("last"), F.col("kept")).otherwise(F.concat("kept", F.array("last"))).alias("boundaries"))
