"""Documents out of segments: summaries, chapters, skip lists, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cadenza.config import DEFAULT, LABELS, Config
from cadenza.functions.expressions import chapter_title, dot, strip
from cadenza.operators.overlap import meeting


def _by_start() -> WindowSpec:
    return Window.partitionBy("video_id").orderBy("start_sec")


def representative_sentence(spans: DataFrame, sentences: DataFrame, vectors: DataFrame | None, key: str, chars: int) -> DataFrame:
    """(video_id, ``key``, text): of the sentences that intersect a span, the one nearest to their mean direction.

    Spans are (video_id, ``key``, start_sec, end_sec). Without vectors, or with a mean of no direction, the longest
    sentence; of equals the first. The text is stripped and cut to ``chars``.
    """
    by = ["video_id", key]
    meets = (F.col("end") > F.col("start_sec")) & (F.col("start") < F.col("end_sec"))
    told = sentences.select("video_id", "pos", "id", "start", "end", "text")
    pairs = meeting(spans.select(*by, "start_sec", "end_sec"), ("start_sec", "end_sec"), told, ("start", "end")).filter(meets)
    if vectors is None:
        vectors = sentences.sparkSession.createDataFrame([], "video_id string, id int, embedding array<double>")
    length = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    scaled = lambda n: F.transform("embedding", lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))
    unit = F.get(F.transform(F.array(length), scaled), 0)  # the length is worked out once for a vector, not for each component
    told = pairs.join(vectors.select("video_id", "id", unit.alias("unit")), ["video_id", "id"], "left")
    means = told.filter("unit is not null").select(*by, F.posexplode("unit").alias("d", "x")).groupBy(*by, "d").agg(F.avg("x").alias("x"))
    centres = means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("c"))
    centres = centres.withColumn("norm", F.sqrt(dot(F.col("c"), F.col("c"))))
    near = told.join(centres.filter("norm > 1e-12"), by, "left").withColumn("near", F.round(dot(F.col("unit"), F.col("c")) / F.col("norm"), 9))
    by_vector = F.max(F.when(F.col("near").isNotNull(), F.struct("near", (-F.col("pos")).alias("back"), "text")))
    by_length = F.max(F.struct(F.char_length("text").alias("n"), (-F.col("pos")).alias("back"), "text"))
    best = near.groupBy(*by).agg(by_vector.alias("v"), by_length.alias("l"))
    return best.select(*by, F.left(strip(F.coalesce("v.text", "l.text")), F.lit(chars)).alias("text"))


def attach_summaries(segment: DataFrame, sentences: DataFrame, vectors: DataFrame | None, config: Config = DEFAULT) -> DataFrame:
    chosen = representative_sentence(segment, sentences, vectors, "segment_id", config.summary_chars)
    return segment.drop("summary").join(chosen.withColumnRenamed("text", "summary"), ["video_id", "segment_id"], "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def chapter_spans(segment: DataFrame) -> DataFrame:
    """(video_id, chapter_id, start_sec, end_sec): stretches of core content."""
    core = F.col("label") == "core_content"
    new = (core & ~F.coalesce(F.lag("label").over(_by_start()) == "core_content", F.lit(False))).cast("int")
    islands = segment.select("video_id", "start_sec", "end_sec", core.alias("core"), new.alias("new"))
    numbered = islands.withColumn("chapter_id", F.sum("new").over(_by_start()) - 1).filter("core")
    return numbered.groupBy("video_id", "chapter_id").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"))


def chapters(segment: DataFrame, sentences: DataFrame, vectors: DataFrame | None, config: Config = DEFAULT) -> DataFrame:
    spans = chapter_spans(segment)
    chosen = representative_sentence(spans, sentences, vectors, "chapter_id", config.title_chars)
    joined = spans.join(chosen, ["video_id", "chapter_id"], "left")
    return joined.select("video_id", F.col("chapter_id").cast("int").alias("chapter_id"), "start_sec", "end_sec", chapter_title(F.col("text"), F.col("chapter_id") + 1, config).alias("title"))


def skip_list(segment: DataFrame) -> DataFrame:
    """(video_id, skip_suggestions): the numbers of all segments that aren't core content, in order."""
    return segment.groupBy("video_id").agg(F.array_sort(F.collect_list(F.when(F.col("label") != "core_content", F.col("segment_id")))).alias("skip_suggestions"))


#: What the fields of each level of a document must hold; fields that aren't named may hold anything or be missing.
BOUNDS = {
    "video_info": {"filename": "any", "duration_sec": ">= 0", "fps": "> 0", "width": "> 0", "height": "> 0"},
    "segments": {"segment_id": ">= 0", "start_sec": ">= 0", "end_sec": ">= 0", "label": "label", "confidence": "share", "evidence": "any"},
    "chapters": {"chapter_id": ">= 0", "start_sec": ">= 0", "end_sec": ">= 0", "title": "any"},
}


def _holds(value: Column, bound: str) -> Column:
    """Whether a field is there and within its bound; NaN is within none."""
    number = value.cast("double")
    fine = {">= 0": lambda: number >= 0, "> 0": lambda: number > 0, "share": lambda: number.between(0, 1), "label": lambda: value.isin(*LABELS), "any": lambda: value.isNotNull()}[bound]()
    return F.coalesce(fine & ~F.isnan(number), F.lit(False)) if bound in (">= 0", "> 0", "share") else F.coalesce(fine, F.lit(False))


def _wrong(item: Column, level: str, place: Column) -> Column:
    """The paths of an item's fields that don't hold what they must."""
    paths = [F.when(~_holds(item[f], bound), F.concat(place, F.lit(f".{f}"))) for f, bound in BOUNDS[level].items()]
    return F.filter(F.array(*paths), lambda x: x.isNotNull())


def violations(metadata: Column) -> Column:
    """The paths of all fields of a document that are missing or out of bounds, such as ``segments[3].confidence``, in order."""

    def each(level: str) -> Column:
        items = F.transform(metadata[level], lambda x, k: F.when(x.isNull(), F.array(F.concat(F.lit(f"{level}["), k, F.lit("]")))).otherwise(_wrong(x, level, F.concat(F.lit(f"{level}["), k, F.lit("]")))))
        return F.coalesce(F.flatten(items), F.array(F.lit(level)))

    info = F.when(metadata["video_info"].isNull(), F.array(F.lit("video_info"))).otherwise(_wrong(metadata["video_info"], "video_info", F.lit("video_info")))
    return F.when(metadata.isNull(), F.array(F.lit("metadata"))).otherwise(F.concat(info, each("segments"), each("chapters")))


def broken(document: DataFrame) -> DataFrame:
    """(video_id, violations) of the documents (video_id, metadata) that are out of bounds."""
    return document.select("video_id", violations(F.col("metadata")).alias("violations")).filter(F.size("violations") > 0)


def broken_segments(segment: DataFrame) -> DataFrame:
    """Rows of a table of segments that are out of bounds, before they are nested."""
    fine = F.lit(True)
    for f, bound in BOUNDS["segments"].items():
        if f in segment.columns:
            fine = fine & _holds(F.col(f), bound)
    return segment.filter(~fine)


def checked(document: DataFrame) -> DataFrame:
    """``document`` (video_id, metadata), failing at run time on one that is out of bounds, with the paths that are."""
    wrong = violations(F.col("metadata"))
    fine = F.assert_true(F.size(wrong) == 0, F.concat(F.lit("invalid document of "), F.coalesce("video_id", F.lit("null")), F.lit(": "), F.array_join(wrong, ", ")))
    return document.filter(fine.isNull())


def unknown_keys(document: Column, expected: list[str]) -> Column:
    """Keys of a JSON object that the schema doesn't know."""
    return F.array_except(F.json_object_keys(document), F.array(*[F.lit(k) for k in expected]))


def documents(info: DataFrame, segment: DataFrame, chapter: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(video_id, metadata): the nested document of each recording of ``info`` (video_id, filename, duration_sec, fps, width, height).

    A document out of bounds fails the job when it is written.
    """
    evidence = F.struct("visual_score", "audio_score", "text_score", "triggered_rules").alias("evidence")
    seg = F.struct("segment_id", "start_sec", "end_sec", "label", "confidence", evidence, "summary", "user_corrected")
    segs = segment.groupBy("video_id").agg(F.array_sort(F.collect_list(seg)).alias("segments"))
    chap = chapter.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("chapter_id", "start_sec", "end_sec", "title"))).alias("chapters"))
    joined = info.join(segs, "video_id", "left").join(chap, "video_id", "left").join(skip_list(segment), "video_id", "left")
    video = F.struct("filename", "duration_sec", "fps", "width", "height", F.lit(config.version).alias("analysis_version"), F.lit(False).alias("verified_by_human"))
    empty = lambda c: F.coalesce(c, F.from_json(F.lit("[]"), joined.schema[c].dataType))
    metadata = F.struct(video.alias("video_info"), empty("segments").alias("segments"), empty("chapters").alias("chapters"), empty("skip_suggestions").alias("skip_suggestions"))
    return checked(joined.select("video_id", metadata.alias("metadata")))
