"""Scalar column functions of frames, stars and optics.

NaN never passes a test here, as in ``nan > 0``; Spark by itself holds NaN for
the greatest number, so each comparison is guarded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCSEC_PER_RADIAN = 206.265  # for micrometres and millimetres


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: Column | str) -> Column:
    return col(x).cast("double")


def positive(x: Column) -> Column:
    """x > 0, and false for NaN."""
    return ~F.isnan(x) & (x > 0)


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def divided(a: Column, b: Column) -> Column:
    """a / b as IEEE has it: infinite or NaN where b is 0."""
    return F.when(b != 0, a / b).when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a.isNotNull() & b.isNotNull(), F.signum(a) * F.lit(float("inf")))


def clamp01(x: Column) -> Column:
    """max(0, 1 - min(1, x)); NaN counts as 1, as the smaller number wins against it."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.lit(1.0), F.nanvl(x, F.lit(1.0))))


def plate_scale(pixel_size: Column | str, focal_length: Column | str) -> Column:
    """Arcseconds a pixel; null if either is missing, infinite for a focal length of 0."""
    return divided(number(pixel_size), number(focal_length)) * F.lit(ARCSEC_PER_RADIAN)


def can_calculate_plate_scale(pixel_size: Column | str, focal_length: Column | str) -> Column:
    return col(pixel_size).isNotNull() & col(focal_length).isNotNull()


def field_of_view(width: Column | str, height: Column | str, scale: Column) -> Column:
    """Arcminutes of both sides; null without a plate scale."""
    side = lambda n: number(n) * scale / F.lit(60.0)
    return F.when(scale.isNotNull(), F.struct(side(width).alias("width"), side(height).alias("height")))


def zone_hours(longitude: Column | str) -> Column:
    """Hours from UTC by longitude, rounded half away from zero."""
    return F.round(number(longitude) / F.lit(15.0)).cast("int")


def session_date(date_obs: Column | str, longitude: Column | str) -> Column:
    """The local noon at or before the observation, written as if in UTC; without a longitude the zone is UTC."""
    local = col(date_obs) + F.make_dt_interval(F.lit(0), F.coalesce(zone_hours(longitude), F.lit(0)) - F.lit(12))
    noon = F.date_trunc("day", local) + F.expr("INTERVAL 12 HOURS")
    return noon


def eccentricity(a: Column | str, b: Column | str) -> Column:
    a, b = number(a), number(b)
    return F.when(a == 0, F.lit(0.0)).otherwise(F.sqrt(F.lit(1.0) - divided(b * b, a * a)))


def fwhm(a: Column | str, b: Column | str) -> Column:
    """The mean of the axes."""
    return (number(a) + number(b)) / F.lit(2.0)


def elongation(a: Column | str, b: Column | str) -> Column:
    a, b = number(a), number(b)
    return F.when(positive(a) & positive(b), a / F.nullif(b, F.lit(0.0))).otherwise(F.lit(1.0))


def star_snr(flux: Column | str, flux_auto: Column | str, fluxerr_auto: Column | str) -> Column:
    """flux_auto / fluxerr_auto, or the square root of the flux where the error isn't positive, or 0."""
    flux, auto, err = number(flux), number(flux_auto), number(fluxerr_auto)
    return F.when(positive(err), auto / F.nullif(err, F.lit(0.0))).when(positive(flux), F.sqrt(flux)).otherwise(F.lit(0.0))


def uniformity(least: Column | str, most: Column | str) -> Column:
    least, most = number(least), number(most)
    return F.when(positive(most), F.lit(1.0) - (most - least) / F.nullif(most, F.lit(0.0))).otherwise(F.lit(1.0))


@dataclass(frozen=True)
class QualityWeights:
    """Weights of the partial scores in the overall one."""

    fwhm: float = 0.3
    eccentricity: float = 0.2
    background: float = 0.2
    kron: float = 0.15
    snr: float = 0.1
    flag: float = 0.05


PARTS = ("fwhm", "eccentricity", "background", "kron", "snr", "flag")


def fwhm_score(median: Column | str, deviation: Column | str) -> Column:
    median, deviation = number(median), number(deviation)
    steady = F.when(positive(median), clamp01(deviation / F.nullif(median, F.lit(0.0)))).otherwise(F.lit(0.0))
    return F.lit(0.7) * clamp01(median / 10) + F.lit(0.3) * steady


def eccentricity_score(median_elongation: Column | str) -> Column:
    """From the elongation; above 1 where that is under 1."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.lit(1.0), F.nanvl((number(median_elongation) - 1) / 2, F.lit(1.0))))


def background_score(uniform: Column | str, rms: Column | str) -> Column:
    return F.lit(0.7) * number(uniform) + F.lit(0.3) * clamp01(number(rms) / 10)


def kron_score(median: Column | str) -> Column:
    return clamp01(number(median) / 10)


def snr_score(median: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.nanvl(F.lit(1.0) - divided(F.lit(10.0), F.lit(10.0) + number(median)), F.lit(0.0)))


def flag_score(fraction: Column | str) -> Column:
    return F.lit(1.0) - number(fraction)


def overall_score(scores: dict[str, Column], weights: QualityWeights = QualityWeights()) -> Column:
    """The weighted mean; 0 where the weights sum to 0."""
    total = sum(getattr(weights, p) for p in PARTS)
    if total == 0:
        return F.lit(0.0)
    return sum((scores[p] * F.lit(getattr(weights, p)) for p in PARTS), F.lit(0.0)) / F.lit(total)


def percentage(n: Column, d: Column) -> Column:
    """100 n / d, and 0 where d is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / F.nullif(d, F.lit(0)).cast("double") * F.lit(100.0))


def format_percentage(x: Column) -> Column:
    return F.format_string("%.6f", x)
