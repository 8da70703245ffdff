"""Scalar and vector functions as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Config


def strip(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once however often, or in whatever function of components, it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a vector without length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def rms(samples: Column) -> Column:
    """Root mean square of a chunk of samples, 0 of an empty one."""
    return F.when(F.size(samples) > 0, F.sqrt(dot(samples, samples) / F.size(samples))).otherwise(0.0)


def entropy(weights: Column) -> Column:
    """Entropy in bits of weights that are scaled to sum to one."""
    sum_ = total(F.transform(weights, lambda w: w.cast("double")))
    return total(F.transform(weights, lambda w: -(w / sum_) * F.log2(w / sum_ + 1e-12)))


def weighted_centre(places: Column, weights: Column) -> Column:
    """Spectral centroid: the mean of places by weight."""
    return dot(places, weights) / total(F.transform(weights, lambda w: w.cast("double")))


def weighted_spread(places: Column, weights: Column) -> Column:
    """Spectral bandwidth: the root mean square distance from the centroid, by weight."""
    centre = weighted_centre(places, weights)
    squares = F.transform(places, lambda f: (f - centre) * (f - centre))
    return F.sqrt(dot(squares, weights) / total(F.transform(weights, lambda w: w.cast("double"))))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(exps, lambda x: x / total(exps))


def scene_map(labels: Column, scores: Column) -> Column:
    """Each scene label with its probability, by softmax over the scores of all labels."""
    return F.map_from_arrays(labels, softmax(scores))


def audio_class(rms_energy: Column, zero_crossing_rate: Column, config: Config = DEFAULT) -> Column:
    """silence, speech, music or noise: the first rule that holds."""
    return (
        F.when(rms_energy < config.silence_rms, "silence")
        .when(zero_crossing_rate > config.speech_zcr, "speech")
        .when(rms_energy > config.music_rms, "music")
        .otherwise("noise")
    )


def matched_keywords(text: Column, config: Config = DEFAULT) -> Column:
    """For each group with a phrase that the text contains, "group:phrase" of its first such phrase, groups in order."""
    lower = F.lower(text)
    first = [F.coalesce(*[F.when(F.contains(lower, F.lit(p)), f"{group}:{p}") for p in phrases]) for group, phrases in config.keywords.items()]
    return F.filter(F.array(*first), lambda m: m.isNotNull())


def first_match(matched: Column, group: str) -> Column:
    return F.get(F.filter(matched, lambda m: F.startswith(m, F.lit(f"{group}:"))), F.lit(0))


def scene_divergence(p: Column, q: Column) -> Column:
    """Symmetric Kullback-Leibler divergence of two scene vectors, clipped to [1e-9, 1] and scaled to sum to one."""

    def scaled(v: Column) -> Column:
        clipped = F.transform(v, lambda x: F.greatest(F.lit(1e-9), F.least(F.lit(1.0), x)))
        shares = lambda c: once(total(c), lambda n: F.transform(c, lambda x: x / n))
        return once(clipped, shares)

    return total(F.zip_with(scaled(p), scaled(q), lambda a, b: 0.5 * (a - b) * F.log(a / b)))


def scene_label(label: Column, config: Config = DEFAULT) -> Column:
    """The segment label of a scene label, core_content where no rule applies."""
    return F.coalesce(*[F.when(F.contains(label, F.lit(part)), target) for part, target in config.scenes], F.lit("core_content"))


def overlap_seconds(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end, other_end) - F.greatest(start, other_start))


def histogram_distance(a: Column, b: Column) -> Column:
    """max(0, 1 - correlation) of two histograms; 0 if either is flat."""
    n = F.size(a)
    ma, mb = total(a) / n, total(b) / n
    da, db = F.transform(a, lambda x: x - ma), F.transform(b, lambda x: x - mb)
    length = F.sqrt(dot(da, da) * dot(db, db))
    return F.when(length > 0, F.greatest(F.lit(0.0), 1 - dot(da, db) / length)).otherwise(0.0)


def chapter_title(text: Column, number: Column, config: Config = DEFAULT) -> Column:
    """A title out of a sentence: "Chapter n" without one, cut at a word where it is long."""
    line = F.regexp_replace(strip(text), r"(?U)\s+", " ")
    cut = F.concat(F.regexp_replace(F.left(line, F.lit(config.title_chars - 3)), " [^ ]*$", ""), F.lit("..."))
    titled = F.when(F.char_length(line) >= config.title_chars, cut).otherwise(line)
    return F.when(F.coalesce(strip(text), F.lit("")) == "", F.concat(F.lit("Chapter "), number)).otherwise(titled)


def safe_stem(name: Column) -> Column:
    """A file name without its ending, unusual characters replaced; "video" where nothing is left."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    clean = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("video"))
