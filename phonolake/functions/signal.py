"""Signals as array columns. Arrays of floats are cast to double before any sum, so that results don't depend on the engine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MU = 255.0


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def duration(a: Column, rate: Column) -> Column:
    return F.size(a) / rate


def rtf(elapsed: Column, seconds: Column) -> Column:
    """Elapsed by duration, with a floor under the duration."""
    return elapsed / F.greatest(seconds, F.lit(1e-9))


def rtf_or_zero(elapsed: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, elapsed / seconds).otherwise(F.lit(0.0))


def resampled_size(n: Column, rate: int, target: int) -> Column:
    return F.greatest(F.lit(1), F.bround(n * F.lit(float(target)) / rate).cast("int"))


def resample(a: Column, rate: int, target: int) -> Column:
    """Linear interpolation on evenly spaced positions, without a filter; the last sample is held. Equal rates change nothing; null and empty arrays stay."""
    if rate == target:
        return a
    n = F.size(a)
    m = resampled_size(n, rate, target)

    def at(i: Column) -> Column:
        x = i * n / m
        k = F.floor(x).cast("int")
        left = F.element_at(a, k + 1)
        right = F.element_at(a, F.least(k + 2, n))
        return left + (right - left) * (x - k)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), m - 1), at)).otherwise(a)


def mu_encode(x: Column) -> Column:
    return F.signum(x) * F.log1p(MU * F.abs(x)) / math.log1p(MU)


def mu_decode(y: Column) -> Column:
    return F.signum(y) * (F.expm1(F.abs(y) * math.log1p(MU)) / MU)


def companded(a: Column) -> Column:
    """Mu-law there and back without steps, as the telephony slice has it."""
    return F.transform(a, lambda x: mu_decode(mu_encode(x)))


def quantized(a: Column, levels: int = 256) -> Column:
    """Eight-bit linear steps there and back."""
    half = levels // 2
    return F.transform(a, lambda x: (F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.floor(x * half) + half)) - half) / float(half))


def clipped(a: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.transform(a, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def noise(n: pd.Series, seed: pd.Series) -> pd.Series:
    """Gaussian noise of deviation 0.008, by the seed of the row."""
    return pd.Series([None if pd.isna(k) or pd.isna(s) else np.random.default_rng(int(s)).normal(0, 0.008, int(k)).astype(np.float32).astype(float) for k, s in zip(n, seed)])


def telephony(df: DataFrame, a: str, rate: int, seed: Column, narrow: int = 8000, name: str = "telephony") -> DataFrame:
    """Adds the signal taken to a narrow rate, mu-law there and back, with seeded noise, back at the rate and clipped."""
    down = df.withColumn("__down", companded(resample(F.col(a), rate, narrow))).withColumn("__noise", noise(F.size("__down"), seed))
    noisy = down.withColumn("__noisy", F.zip_with("__down", "__noise", lambda x, e: x + e))
    return noisy.withColumn(name, clipped(resample(F.col("__noisy"), narrow, rate))).drop("__down", "__noise", "__noisy")


def training_telephony(a: Column, rate: int, narrow: int = 8000) -> Column:
    """To a narrow rate, eight-bit linear steps, and back."""
    return resample(quantized(resample(a, rate, narrow)), narrow, rate)


#: Factors of speed perturbation.
SPEEDS = (0.9, 1.0, 1.1)


def speed_factor(key: Column) -> Column:
    """One of the factors, by the key alone, so that a lost task gives the same."""
    return F.element_at(F.array(*[F.lit(x) for x in SPEEDS]), (F.pmod(F.xxhash64(key), F.lit(len(SPEEDS))) + 1).cast("int"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def change_speed(a: pd.Series, factor: pd.Series) -> pd.Series:
    def one(x, f):
        if x is None or not len(x):
            return x
        n = max(1, round(len(x) / f))
        return np.interp(np.linspace(0, 1, n, endpoint=False), np.linspace(0, 1, len(x), endpoint=False), np.asarray(x, float))

    return pd.Series([one(x, f) for x, f in zip(a, factor)])


def gate(key: Column, share: float, salt: int) -> Column:
    """True for about this share of the keys."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1000)) < round(1000 * share)


def polyphase(rate: int, target: int, taps: int = 10):
    """Arrow function: resampling by a windowed-sinc filter between the steps of the common divisor."""
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    half = taps * max(up, down)
    t = np.arange(-half, half + 1)
    kernel = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    kernel *= up / kernel.sum()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(a: pd.Series) -> pd.Series:
        def one(x):
            if x is None or not len(x) or up == down:
                return x
            stuffed = np.zeros(len(x) * up)
            stuffed[::up] = x
            full = np.convolve(stuffed, kernel)[half:]
            return full[: len(x) * up : down][: -(-len(x) * up // down)]

        return pd.Series([one(x) for x in a])

    return run


def mono(frames: Column) -> Column:
    """Mean of the channels of each frame."""
    return F.transform(frames, lambda f: F.aggregate(f, F.lit(0.0), lambda s, x: s + x) / F.size(f))


def channel(frames: Column, mode: Column | str) -> Column:
    """left, right, average or mono of frames of one or more channels.

    Right of a single channel is an error, as is an unknown mode; null and empty arrays stay.
    """
    mode = F.lit(mode) if isinstance(mode, str) else mode
    width = F.size(F.get(frames, F.lit(0)))
    right = F.when(width > 1, F.transform(frames, lambda f: F.element_at(f, 2))).otherwise(F.raise_error("right channel of a single-channel signal").cast("array<double>"))
    return (
        F.when(frames.isNull() | (F.size(frames) == 0), F.array().cast("array<double>"))
        .when(mode == "left", F.transform(frames, lambda f: F.element_at(f, 1)))
        .when(mode == "right", right)
        .when(mode.isin("average", "mono"), mono(frames))
        .otherwise(F.raise_error(F.concat(F.lit("unknown channel mode "), mode)).cast("array<double>"))
    )


def fit_length(a: Column, n: Column | int) -> Column:
    """Cut or padded with zeros to n samples."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(a), F.lit(0)))), F.lit(1), n)


def tumbling(a: Column, size: int) -> Column:
    """Array of structs (chunk_index, start, chunk), the rest kept, none for an empty array."""
    starts = F.sequence(F.lit(0), F.size(a) - 1, F.lit(size))
    return F.when(F.size(a) > 0, F.transform(starts, lambda s, i: F.struct(i.alias("chunk_index"), s.alias("start"), F.slice(a, s + 1, F.lit(size)).alias("chunk"))))


def overlapped_count(n: Column, size: int, overlap: int) -> Column:
    """Chunks of n samples: one if they fit, else no chunk that would lie in the overlap alone."""
    return F.when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(size - overlap)) + 1).cast("int")


def overlapped(a: Column, size: int, overlap: int) -> Column:
    """Array of structs (chunk_index, start, stop, chunk, stride_left, stride_right); an empty array gives one empty chunk."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("chunk must be positive, overlap not negative and smaller than the chunk")
    n = F.size(a)
    k = overlapped_count(n, size, overlap)
    step = size - overlap

    def one(i: Column) -> Column:
        return F.struct(
            i.alias("chunk_index"), (i * step).alias("start"), F.least(i * step + size, n).alias("stop"), F.slice(a, i * step + 1, F.lit(size)).alias("chunk"),
            F.when(i > 0, overlap).otherwise(0).alias("stride_left"), F.when(i < k - 1, overlap).otherwise(0).alias("stride_right"),
        )

    return F.when(a.isNotNull(), F.transform(F.sequence(F.lit(0), k - 1), one))


def streamed(a: Column, first: int, size: int, hop: int, window: int, first_frames: int, frames: int) -> Column:
    """First chunk, then chunks of ``size`` that start at frame * hop - window / 2, padded with zeros; it ends once a chunk reaches the end."""
    n = F.size(a)
    begin = first_frames * hop - window // 2
    step = frames * hop
    more = F.when(n <= begin, 0).otherwise(F.greatest(F.lit(1), F.ceil((n - begin - size) / F.lit(step)) + 1)).cast("int")
    rest = F.transform(
        F.when(more > 0, F.sequence(F.lit(0), more - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct((i + 1).alias("chunk_index"), (i * step + begin).alias("start"), fit_length(F.slice(a, i * step + begin + 1, F.lit(size)), size).alias("chunk")),
    )
    head = F.array(F.struct(F.lit(0).alias("chunk_index"), F.lit(0).alias("start"), fit_length(F.slice(a, 1, first), first).alias("chunk")))
    return F.concat(head, rest)


def slices(a: Column, spans: Column) -> Column:
    """The parts of a between start and end (samples) of each span, one after the other; spans that end where they start give nothing."""
    n = F.size(a)

    def part(s: Column) -> Column:
        lo, hi = F.greatest(F.lit(0), s["start"]).cast("int"), F.least(n, s["end"]).cast("int")
        return F.when(hi > lo, F.slice(a, lo + 1, F.greatest(hi - lo, F.lit(0)))).otherwise(F.slice(a, 1, 0))

    return F.flatten(F.transform(spans, part))


def speaker_slices(a: Column, rate: Column, turns: Column, speaker: Column) -> Column:
    """The parts of one speaker's turns (seconds, rounded half to even to samples)."""
    own = F.filter(turns, lambda t: t["speaker"] == speaker)
    return slices(a, F.transform(own, lambda t: F.struct(F.bround(t["start"] * rate).cast("int").alias("start"), F.bround(t["end"] * rate).cast("int").alias("end"))))


def speech_spans(a: Column, threshold: float) -> Column:
    """Speech spans by level: maximal runs of samples at or above the threshold, as structs (start, end)."""
    loud = F.transform(a, lambda x: F.abs(x) >= threshold)
    n = F.size(a)
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(loud, i + 1) & ((i == 0) | ~F.element_at(loud, F.greatest(i, F.lit(1)))))
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(loud, i) & ((i == n) | ~F.element_at(loud, F.least(i + 1, n))))
    return F.when(n > 0, F.zip_with(begins, ends, lambda s, e: F.struct(s.cast("bigint").alias("start"), e.cast("bigint").alias("end"))))


def for_each_batch(df: DataFrame, function, schema: str) -> DataFrame:
    """A numpy function of pandas batches over a table; for models that only take arrays."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)
