"""Sound and picture features that need array mathematics, in numpy, on batches of rows."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 16_000


def spectrum(chunk: np.ndarray, rate: int = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and mean magnitudes of the short-time Fourier transform: windows of up to 512 samples, half overlapping, centred."""
    n = min(512, len(chunk))
    hop = max(1, n // 2)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    padded = np.pad(chunk.astype(np.float64), n // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, n)[::hop]
    return np.fft.rfftfreq(n, 1 / rate), np.abs(np.fft.rfft(frames * window, axis=1)).mean(axis=0) + 1e-10


def zero_crossing_rate(chunk: np.ndarray, frame: int = 2048, hop: int = 256) -> float:
    """Mean over centred frames of the share of samples whose sign differs from the one before."""
    padded = np.pad(chunk, frame // 2, mode="edge")
    signs = np.signbit(padded)
    crossings = np.concatenate([[0], np.cumsum(signs[1:] != signs[:-1])])
    starts = np.arange(0, len(padded) - frame + 1, hop)
    return float(np.mean((crossings[starts + frame - 1] - crossings[starts]) / frame))


def chunk_features(chunk: np.ndarray, rate: int = RATE) -> tuple[float, float, float, float, float]:
    """RMS, spectral centroid and bandwidth, zero-crossing rate and spectral entropy of one second; zeros of an empty one."""
    if not len(chunk):
        return (0.0,) * 5
    rms = float(np.sqrt(np.mean(chunk.astype(np.float64) ** 2)))
    f, m = spectrum(chunk, rate)
    p = m / m.sum()
    centroid = float(f @ p)
    bandwidth = float(np.sqrt(((f - centroid) ** 2) @ p))
    zcr = zero_crossing_rate(chunk, hop=max(1, min(512, len(chunk)) // 2))
    return rms, centroid, bandwidth, zcr, float(-(p @ np.log2(p + 1e-12)))


COEFFICIENTS = 20
_BANDS, _FRAME, _HOP = 128, 2048, 512


def mel(hertz: np.ndarray) -> np.ndarray:
    """The mel scale that is linear up to 1000 Hz and logarithmic above."""
    hertz = np.asarray(hertz, np.float64)
    return np.where(hertz < 1000, hertz * 3 / 200, 15 + np.log(np.maximum(hertz, 1000) / 1000) * 27 / np.log(6.4))


def hertz(mels: np.ndarray) -> np.ndarray:
    return np.where(mels < 15, mels * 200 / 3, 1000 * np.exp((np.maximum(mels, 15) - 15) * np.log(6.4) / 27))


@functools.lru_cache(4)
def mel_bands(rate: int) -> np.ndarray:
    """Weights of the frequencies (columns) in each band (rows): triangles evenly spaced in mel, each of area one."""
    edges = hertz(np.linspace(0, mel(rate / 2), _BANDS + 2))
    f = np.fft.rfftfreq(_FRAME, 1 / rate)
    rising = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    falling = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rising, falling)) * (2 / (edges[2:] - edges[:-2]))[:, None]


@functools.cache
def _cepstral() -> np.ndarray:
    """The first rows of the orthonormal cosine transform."""
    k, n = np.arange(COEFFICIENTS)[:, None], np.arange(_BANDS)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * _BANDS)) * np.sqrt(np.where(k == 0, 1, 2) / _BANDS)


def cepstrum(chunk: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Mel-frequency cepstral coefficients, their mean over the frames of one second; zeros of an empty one.

    Frames of 2048 samples every 512, centred, in a Hann window; powers in mel bands, in decibels down to 80 below the
    loudest; the cosine transform of these.
    """
    if not len(chunk):
        return np.zeros(COEFFICIENTS)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(_FRAME) / _FRAME)
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(chunk.astype(np.float64), _FRAME // 2), _FRAME)[::_HOP]
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    loud = 10 * np.log10(np.maximum(power @ mel_bands(rate).T, 1e-10))
    return (np.maximum(loud, loud.max() - 80) @ _cepstral().T).mean(axis=0)


def sound_cepstra(chunks: DataFrame, rate: int = RATE) -> DataFrame:
    """(video_id, t, mfcc): the cepstral coefficients of each second of ``chunks`` (video_id, t, samples), rounded to four digits; a null chunk is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [np.round(cepstrum(np.asarray([] if s is None else s, np.float32), rate), 4) for s in pdf["samples"]]
            yield pdf[["video_id", "t"]].assign(mfcc=found)

    return chunks.select("video_id", "t", "samples").mapInPandas(run, "video_id string, t int, mfcc array<double>")


FEATURES = ["rms_energy", "spectral_centroid", "spectral_bandwidth", "zero_crossing_rate", "spectral_entropy"]
DIGITS = (6, 2, 2, 6, 4)


def sound_features(chunks: DataFrame, rate: int = RATE) -> DataFrame:
    """``chunks`` (video_id, t, samples) with the features of each second."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[round(x, d) for x, d in zip(chunk_features(np.asarray(s, np.float32), rate), DIGITS, strict=True)] for s in pdf["samples"]]
            yield pd.concat([pdf[["video_id", "t"]].reset_index(drop=True), pd.DataFrame(found, columns=FEATURES)], axis=1)

    return chunks.select("video_id", "t", "samples").mapInPandas(run, "video_id string, t int, " + ", ".join(f"{n} double" for n in FEATURES))


def speech_seconds(intervals: DataFrame, seconds: DataFrame) -> DataFrame:
    """(video_id, t): the seconds of ``seconds`` (video_id, t) that a speech interval (video_id, start, end) touches."""
    spans = intervals.select("video_id", F.greatest(F.lit(0), F.floor("start")).cast("int").alias("s"), F.ceil("end").cast("int").alias("e")).filter("e > s")
    touched = spans.select("video_id", F.explode(F.sequence("s", F.col("e") - 1)).alias("t"))
    return seconds.join(touched, ["video_id", "t"], "left_semi")


def hsv_histogram(rgb: np.ndarray) -> np.ndarray:
    """8 x 8 x 8 bins of hue (half degrees, below 180), saturation and value, scaled to length one."""
    x = rgb.reshape(-1, 3).astype(np.float64)
    top, low = x.max(axis=1), x.min(axis=1)
    spread = top - low
    s = np.where(top > 0, spread / np.maximum(top, 1) * 255, 0)
    r, g, b = x.T
    safe = np.maximum(spread, 1e-9)
    h = np.where(top == r, 60 * (g - b) / safe, np.where(top == g, 120 + 60 * (b - r) / safe, 240 + 60 * (r - g) / safe))
    h = np.where(spread > 0, h % 360, 0) / 2
    at = [np.minimum((v * 8 / most).astype(int), 7) for v, most in ((np.rint(h) % 180, 180), (np.rint(s), 256), (top, 256))]
    counts = np.bincount(np.ravel_multi_index(at, (8, 8, 8)), minlength=512).astype(np.float64)
    return counts / max(np.linalg.norm(counts), 1e-12)


def grey(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb @ np.array([0.299, 0.587, 0.114]))


def chroma(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chroma planes, each 2 x 2 block averaged."""
    x = rgb.astype(np.float64)
    y = x @ np.array([0.299, 0.587, 0.114])
    out = []
    for c, scale in ((x[..., 2], 0.564), (x[..., 0], 0.713)):
        p = np.clip(np.rint((c - y) * scale + 128), 0, 255)
        h, w = max(1, p.shape[0] // 2), max(1, p.shape[1] // 2)
        p = p[: max(2 * h, 1), : max(2 * w, 1)] if min(p.shape) > 1 else p
        out.append(p.reshape(h, p.shape[0] // h, w, p.shape[1] // w).mean(axis=(1, 3)))
    return out[0], out[1]


@functools.cache
def _cosines() -> np.ndarray:
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.cos((2 * x + 1) * u * np.pi / 16) / 2 * np.where(u == 0, np.sqrt(0.5), 1)


def detail_energy(picture: np.ndarray) -> float:
    """Energy of the lower right quarter of all 8 x 8 cosine transforms, by block and block area; 0 for a smaller picture."""
    h, w = picture.shape[0] // 8, picture.shape[1] // 8
    if not h or not w:
        return 0.0
    blocks = picture[: 8 * h, : 8 * w].astype(np.float64).reshape(h, 8, w, 8).swapaxes(1, 2)
    m = _cosines()
    high = (m @ blocks @ m.T)[..., 4:, 4:]
    return float((high**2).sum() / (h * w) / 8**4)


FRAME_COLUMNS = (
    "video_id string, frame_index int, timestamp_sec double, hist_diff_to_previous double, is_hard_cut boolean, mean_luminance double, luminance_variance double, "
    "is_black_frame boolean, motion_intensity double, chroma_diff double, dct_hf_energy double"
)


def frame_features(frames: DataFrame, decode: Callable[[bytes], np.ndarray | None], cut: float = 0.6) -> DataFrame:
    """Features of frames (video_id, frame_index, timestamp_sec, content) against the last readable frame before.

    ``decode`` gives a height x width x 3 array of a picture's bytes, or None for what it can't read; such frames are left
    out. Frames pass through tasks in order of recording and time; a task holds one frame besides the current batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, before = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                rgb = decode(row.content)
                if rgb is None:
                    continue
                if row.video_id != video:
                    video, before = row.video_id, None
                now = (hsv_histogram(rgb), grey(rgb), chroma(rgb))
                difference = motion = colour = 0.0
                if before is not None and before[1].shape == now[1].shape:
                    a, b = before[0] - before[0].mean(), now[0] - now[0].mean()
                    length = np.sqrt((a @ a) * (b @ b))
                    difference = round(max(0.0, 1 - float(a @ b / length)), 6) if length > 0 else 0.0
                    motion = float(np.abs(before[1] - now[1]).mean())
                    colour = float(sum(np.abs(p - q).mean() for p, q in zip(before[2], now[2], strict=True)) / 2 / 255)
                mean, variance = float(now[1].mean()), float(now[1].var())
                out.append((video, row.frame_index, row.timestamp_sec, difference, difference > cut, mean, variance, mean < 10 and variance < 50, motion, colour, detail_energy(now[1])))
                before = now
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FRAME_COLUMNS.split(", ")])

    ordered = frames.select("video_id", "frame_index", "timestamp_sec", "content").repartition("video_id").sortWithinPartitions("video_id", "frame_index")
    return ordered.mapInPandas(run, FRAME_COLUMNS)
