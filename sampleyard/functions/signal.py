"""Operators on short signals held as ARRAY<DOUBLE>, in expressions only (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import taxonomy as T
from .names import let


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def energy(y: Column) -> Column:
    return total(F.transform(y, lambda v: v * v))


def zero_crossing_rate(y: Column) -> Column:
    """Share of samples whose sign differs from the one before (the first never does)."""
    sign = F.transform(y, lambda v: v < 0)
    pairs = F.zip_with(F.slice(sign, 2, F.greatest(F.size(y) - 1, F.lit(0))), F.slice(sign, 1, F.greatest(F.size(y) - 1, F.lit(0))), lambda a, b: (a != b).cast("double"))
    return F.when(F.size(y) > 0, total(pairs) / F.size(y)).otherwise(0.0)


def log_attack_time(y: Column, rate: float) -> Column:
    """log10 of the seconds before the peak, 1e-4 at least; -3 of an empty signal."""
    size = F.transform(y, lambda v: F.abs(v))
    at = F.array_position(size, F.array_max(size)) - 1
    return F.when(F.size(y) > 0, F.log10(F.greatest(at / F.lit(float(rate)), F.lit(1e-4)))).otherwise(-3.0)


def pitch_stability(f0: Column) -> Column:
    """Standard deviation over mean of the voiced pitches; 1 with fewer than two or no positive mean."""
    voiced = F.filter(f0, lambda v: v.isNotNull() & ~F.isnan(v))

    def ratio(mean: Column) -> Column:
        spread = F.sqrt(total(F.transform(voiced, lambda v: (v - mean) * (v - mean))) / F.size(voiced))
        return F.when(mean > 0, spread / mean).otherwise(1.0)

    return F.when(F.size(voiced) >= 2, let(total(voiced) / F.size(voiced), ratio)).otherwise(1.0)


def energy_ratio(part: Column, rest: Column) -> Column:
    """Share of the energy that is in ``part``; 0 of silence."""
    both = energy(part) + energy(rest)
    return F.when(both > 0, energy(part) / both).otherwise(0.0)


def _correlation(x: Column, profile: list[float]) -> Column:
    n = float(len(profile))  # x is an array column
    mean_p = sum(profile) / n
    centred = [v - mean_p for v in profile]
    spread_p = sum(v * v for v in centred) ** 0.5
    # the profile is centred, so the signal's mean drops out of the covariance
    cov = total(F.zip_with(x, F.array(*[F.lit(v) for v in centred]), lambda a, b: a * b))
    spread_x = F.sqrt(let(total(x) / n, lambda mean: total(F.transform(x, lambda a: (a - mean) * (a - mean)))))
    return cov / (spread_x * spread_p)


def detect_key(chroma: Column) -> Column:
    """STRUCT<key, scale> of the rotated profile that correlates best with 12 chroma energies; C major where none does."""
    flat = F.array_max(chroma) == F.array_min(chroma)
    scored = []
    for shift in range(12):
        for order, (scale, profile) in enumerate((("major", T.MAJOR_PROFILE), ("minor", T.MINOR_PROFILE))):
            rolled = [profile[(i - shift) % 12] for i in range(12)]
            scored.append(F.struct((-_correlation(chroma, rolled)).alias("neg"), F.lit(2 * shift + order).alias("order"), F.lit(T.PITCH_CLASSES[shift]).alias("key"), F.lit(scale).alias("scale")))
    best = F.get(F.array_sort(F.array(*scored)), F.lit(0))
    return F.when(flat | chroma.isNull(), F.struct(F.lit("C").alias("key"), F.lit("major").alias("scale"))).otherwise(F.struct(best["key"].alias("key"), best["scale"].alias("scale")))


def four_on_the_floor(y: Column, step: int, beats: int) -> Column:
    """The signal laid out ``beats`` times at ``step`` samples, overlaps added, peak-normalised."""
    length = F.lit(step * beats) + F.size(y)

    def sample(t: Column) -> Column:
        hits = F.transform(F.sequence(F.lit(0), F.lit(beats - 1)), lambda k: t - k * step)
        inside = F.filter(hits, lambda i: (i >= 0) & (i < F.size(y)))
        return total(F.transform(inside, lambda i: F.get(y, i)))

    mixed = F.transform(F.sequence(F.lit(0), length - 1), sample)
    return let(mixed, lambda m: let(F.array_max(F.transform(m, lambda v: F.abs(v))), lambda peak: F.when(peak > 0, F.transform(m, lambda v: v / peak)).otherwise(m)))
