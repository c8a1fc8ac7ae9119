"""Signals in array columns, as expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: what a lambda closes over is computed for each element."""
    return F.transform(F.array(value), body)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def power(x: Column) -> Column:
    """Mean square, 0 for an empty signal."""
    return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x)).otherwise(0.0)


def rms(x: Column) -> Column:
    return F.sqrt(power(x))


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(0.0))


def to_float(x: Column) -> Column:
    return F.transform(x, lambda v: v / F.lit(32768.0))


def to_int16(x: Column) -> Column:
    """Clipped to -1 … 1, times 32767, cut off towards zero."""
    return F.transform(x, lambda v: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)) * 32767).cast("smallint"))


def peak_int16(x: Column) -> Column:
    scale = F.lit(32767.0) / F.greatest(F.lit(0.01), peak(x))
    return let(scale, lambda k: F.transform(x, lambda v: F.greatest(F.lit(-32767.0), F.least(F.lit(32767.0), v * k)).cast("smallint")))


def scaled(x: Column, gain: Column) -> Column:
    return let(gain, lambda g: F.transform(x, lambda v: v * g))


def decibels(gain_db: Column) -> Column:
    return F.pow(F.lit(10.0), gain_db / 20)


def snr_gain(signal: Column, noise: Column, snr_db: Column) -> Column:
    """The factor on the noise that gives the ratio of powers; 0 for silent noise."""
    p = power(noise)
    return F.when(p > 0, F.sqrt(power(signal) / (p * F.pow(F.lit(10.0), snr_db / 10)))).otherwise(0.0)


def added(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), n).cast("int"))


def tiled(x: Column, start: Column, n: Column) -> Column:
    """n samples of the looped signal from `start` on."""
    size = F.size(x)
    first = F.pmod(start, F.greatest(size, F.lit(1)))
    times = F.ceil((first + n) / F.greatest(size, F.lit(1))).cast("int")
    return F.when((size > 0) & (n > 0), F.slice(F.flatten(F.array_repeat(x, times)), (first + 1).cast("int"), n.cast("int"))).otherwise(zeros(n))


def rolled(x: Column, by: Column) -> Column:
    return tiled(x, -by, F.size(x))


def end_aligned(x: Column, n: int, jitter: Column) -> Column:
    """The signal near the end of n samples, `jitter` before it; of a longer one its end."""
    kept = F.slice(x, F.greatest(F.lit(1), F.size(x) - n + 1), F.lit(n))
    free = F.lit(n) - F.size(kept)
    after = F.least(free, jitter).cast("int")
    return F.concat(zeros(free - after), kept, zeros(after))


def with_context(x: Column, context: Column, n: int, jitter: Column, gap: Column, gain_db: Column) -> Column:
    """`end_aligned`, with the end of other speech before it: `gap` samples between, at the level of `x` and a gain.

    No room before the gap, or no context, leaves the space silent.
    """
    window = end_aligned(x, n, jitter)
    kept = F.least(F.size(x), F.lit(n))
    begin = F.lit(n) - kept - F.least(F.lit(n) - kept, jitter).cast("int")
    until = begin - gap
    tail = F.slice(context, F.greatest(F.lit(1), F.size(context) - until + 1), F.greatest(F.lit(0), until))
    level = F.when(rms(x) > 0, rms(x) / (rms(tail) + 1e-8)).otherwise(1.0) * decibels(gain_db)
    filled = F.concat(zeros(until - F.size(tail)), scaled(tail, level), zeros(F.lit(n) - until))
    return F.when((until > 0) & (F.size(context) > 0), added(window, filled)).otherwise(window)


def segments(x: Column, starts: Column, reversed_: Column, n: int) -> Column:
    """A clip of n samples from a short one: turns of it from drawn starts on, some of them backwards, end to end."""
    turns = F.transform(F.arrays_zip(starts.alias("s"), reversed_.alias("b")), lambda d: F.when(d["b"], F.reverse(rolled(x, -d["s"]))).otherwise(rolled(x, -d["s"])))
    return F.slice(F.flatten(turns), 1, n)


def centred(x: Column, n: int) -> Column:
    """Padded on both sides, or cut to the middle n samples."""
    extra = F.size(x) - n
    cut = F.slice(x, F.greatest(F.lit(0), F.floor(extra / 2)).cast("int") + 1, F.lit(n))
    free = F.greatest(F.lit(0), -extra)
    before = F.floor(free / 2)
    return F.concat(zeros(before), cut, zeros(free - before))


def joined(left: Column, gap: Column, right: Column) -> Column:
    return F.concat(left, zeros(gap), right)


def frames(x: Column, n: int) -> Column:
    """Frames of n samples, the last filled up with zeros."""
    count = F.ceil(F.size(x) / n).cast("int")
    whole = F.concat(x, zeros(count * n - F.size(x)))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(whole, i * n + 1, F.lit(n)))).otherwise(F.array().cast("array<array<double>>"))


def floored(bands: Column, depth: float = 8.0) -> Column:
    """Values no more than `depth` below the greatest of all frames."""
    low = F.array_max(F.transform(bands, lambda r: F.array_max(r))) - depth
    return let(low, lambda least: F.transform(bands, lambda r: F.transform(r, lambda v: F.greatest(v, least))))


def mel_windows(bands: Column, width: int = 76, stride: int = 8) -> Column:
    """Windows of `width` frames every `stride`."""
    n = F.greatest(F.lit(0), F.floor((F.size(bands) - width) / stride) + 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.slice(bands, i * stride + 1, F.lit(width)))).otherwise(F.array().cast("array<array<array<double>>>"))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def blended(x: Column, y: Column, t: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a * t + b * (1 - t))


def slerp(x: Column, y: Column, t: Column, straight: float = 0.9995) -> Column:
    """Spherical interpolation; straight where the directions nearly agree or oppose, or one is null."""
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    cosine = F.when(norms > 0, dot(x, y) / norms).otherwise(1.0)

    def weights(c: Column) -> Column:
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
        bent = F.struct((F.sin((1 - t) * angle) / F.sin(angle)).alias("x"), (F.sin(t * angle) / F.sin(angle)).alias("y"))
        return F.when(F.abs(c) > straight, F.struct((1 - t).cast("double").alias("x"), t.cast("double").alias("y"))).otherwise(bent)

    return let(let(cosine, weights), lambda w: F.zip_with(x, y, lambda a, b: a * w["x"] + b * w["y"]))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def level_meter(x: Column) -> Column:
    """-60 … 0 dB of full scale as 0 … 1."""
    db = F.when(rms(x) > 0, 20 * F.log10(rms(x))).otherwise(-60.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (db + 60) / 60))
