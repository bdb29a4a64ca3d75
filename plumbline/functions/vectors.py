"""Vector and signal arithmetic on array<double> columns, with higher-order functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import let

def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def cosine(x: Column, y: Column) -> Column:
    """With 1e-8 added to the denominator, so that zero vectors give 0."""
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)) + 1e-8)


def closeness(a: Column, b: Column) -> Column:
    """Two cosines to one score in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.25 * (a + 1) + 0.25 * (b + 1)))


def rms(x: Column) -> Column:
    return F.coalesce(F.sqrt(F.try_divide(dot(x, x), F.size(x))), F.lit(0.0))


def db_ratio(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def scale_to_snr(reference: Column, noise: Column, db: Column) -> Column:
    """noise at a level of db below the reference; unchanged if either is silent."""
    levels = F.struct(rms(reference).alias("r"), rms(noise).alias("n"), db_ratio(db).alias("d"))
    scaled = lambda x: let(x["r"] / x["d"] / x["n"], lambda factor: F.transform(noise, lambda v: v * factor))
    return let(levels, lambda x: F.when((x["r"] <= 0) | (x["n"] <= 0), noise).otherwise(scaled(x)))


def mean_difference(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: F.abs(a - b))) / F.size(x)


def level_db(x: Column) -> Column:
    return 20 * F.log10(rms(x) + 1e-8)


def si_sdr(estimate: Column, reference: Column) -> Column:
    """Scale-invariant signal-to-distortion ratio over the common length; NaN if that is empty or the reference silent."""
    n = F.least(F.size(estimate), F.size(reference))

    def ratio(e: Column, r: Column) -> Column:
        def by_scale(scale: Column) -> Column:
            noise = F.zip_with(e, r, lambda a, b: a - scale * b)
            return 10 * F.log10((scale * scale * dot(r, r) + 1e-8) / (let(noise, lambda x: dot(x, x)) + 1e-8))

        silent = ~F.exists(r, lambda v: F.abs(v) > 1e-8)
        return F.when((F.size(r) == 0) | silent, float("nan")).otherwise(let(dot(e, r) / (dot(r, r) + 1e-8), by_scale))

    cut = F.struct(F.slice(estimate, F.lit(1), n).alias("e"), F.slice(reference, F.lit(1), n).alias("r"))
    return let(cut, lambda x: ratio(x["e"], x["r"]))


def fit_length(x: Column, n: Column) -> Column:
    """x repeated or cut to n values."""
    times = F.ceil(n / F.size(x)).cast("int")
    return F.slice(F.flatten(F.array_repeat(x, times)), F.lit(1), n)


def match_length(x: Column, n: Column) -> Column:
    """x cut, or padded with zeros, to n values."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), n - F.size(x)))), F.lit(1), n)


def fade(x: Column, length: Column) -> Column:
    """A raised-cosine fade over `length` values (half of x at most) at both ends."""
    def faded(given: Column) -> Column:
        y, size, n = given["y"], given["size"], given["n"]
        gain = lambda i: 0.5 * (1 - F.cos(math.pi * i / F.greatest(F.lit(1), n - 1)))
        from_end = lambda i: size - 1 - i
        return F.transform(y, lambda v, i: v * F.when(i < n, gain(i)).otherwise(1.0) * F.when(from_end(i) < n, gain(from_end(i))).otherwise(1.0))

    sized = let(x, lambda y: F.struct(y.alias("y"), F.size(y).alias("size"), F.least(length, F.floor(F.size(y) / 2).cast("int")).alias("n")))
    return let(sized, faded)


def remove_offset(x: Column) -> Column:
    """x less its mean."""
    return let(total(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean))


def pre_emphasis(x: Column, coefficient: float) -> Column:
    """y0 = x0, then y = x - c * the value before."""
    return F.transform(x, lambda v, i: F.when(i == 0, v).otherwise(v - coefficient * F.get(x, i - 1)))


def normalise_peak(x: Column, level: float) -> Column:
    return let(F.array_max(F.transform(x, F.abs)), lambda peak: F.when(peak > 0, F.transform(x, lambda v: v / peak * level)).otherwise(x))


def normalise_rms(x: Column, level: float) -> Column:
    return let(rms(x), lambda r: F.when(r > 0, F.transform(x, lambda v: v / r * (level / math.sqrt(2)))).otherwise(x))
