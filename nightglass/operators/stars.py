"""Stars to frames: shapes, robust aggregates and the brightest stars of a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightglass.functions import scalars as X

MEASURES = ("fwhm", "eccentricity", "kron_radius", "flux_auto", "snr", "elongation")
STATS = (
    "median_fwhm", "median_eccentricity", "fwhm_std_dev", "eccentricity_std_dev", "median_kron_radius", "median_flux", "median_snr",
    "median_elongation", "flagged_fraction", "kron_radius_std_dev", "flux_std_dev", "snr_std_dev",
)


def with_shapes(stars: DataFrame) -> DataFrame:
    """Add eccentricity, fwhm, elongation and snr to stars with a, b, flux, flux_auto and fluxerr_auto."""
    return stars.withColumns({"eccentricity": X.eccentricity("a", "b"), "fwhm": X.fwhm("a", "b"), "elongation": X.elongation("a", "b"), "snr": X.star_snr("flux", "flux_auto", "fluxerr_auto")})


def upper_median(x: str) -> Column:
    """The element at position n // 2 of the sorted values, NaN last; no interpolation."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{x}` DESC)")


def flagged_fraction(flag: str = "flag") -> Column:
    return F.avg((F.col(flag) != 0).cast("double"))


def brightest(stars: DataFrame, frame: str, n: int, order: Sequence[str], flux: str = "flux") -> DataFrame:
    """The ``n`` brightest stars of each frame, NaN first, ties by ``order``.

    Spark limits each task's groups before the shuffle (WindowGroupLimit).
    """
    ranked = Window.partitionBy(frame).orderBy(F.desc(flux), *order)
    return stars.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= n).drop("_rank")


def star_stats(stars: DataFrame, frame: str, top: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Count, upper medians, population deviations and flagged fraction of each frame's stars.

    With ``top`` the statistics are those of the brightest stars, and the count
    still that of all.  Expects the columns of ``with_shapes``.
    """
    used = stars if top is None else brightest(stars, frame, top, order)
    stats = used.groupBy(frame).agg(
        F.count(F.lit(1)).alias("count"),
        upper_median("fwhm").alias("median_fwhm"), upper_median("eccentricity").alias("median_eccentricity"), F.stddev_pop("fwhm").alias("fwhm_std_dev"), F.stddev_pop("eccentricity").alias("eccentricity_std_dev"),
        upper_median("kron_radius").alias("median_kron_radius"), upper_median("flux_auto").alias("median_flux"), upper_median("snr").alias("median_snr"), upper_median("elongation").alias("median_elongation"), flagged_fraction().alias("flagged_fraction"),
        F.stddev_pop("kron_radius").alias("kron_radius_std_dev"), F.stddev_pop("flux_auto").alias("flux_std_dev"), F.stddev_pop("snr").alias("snr_std_dev"),
    )
    if top is None:
        return stats
    # all stars are counted apart, so that only the brightest of each task are shuffled with their columns
    counts = stars.groupBy(frame).agg(F.count(F.lit(1)).alias("count"))
    return counts.join(stats.drop("count"), frame)


def _double(name: str):
    return lambda e: e[name].cast("double")


def array_stats(stars: Column | str) -> dict[str, Column]:
    """``star_stats`` of a frame's stars in one array, as columns by name, without a shuffle; 0 without stars."""
    s = X.col(stars)
    n = F.size(s)
    fields = {m: F.transform(s, _double(m)) for m in MEASURES if m != "snr"}
    fields["snr"] = F.transform(s, lambda e: X.star_snr(e["flux"], e["flux_auto"], e["fluxerr_auto"]).cast("double"))
    add, zero = (lambda t, x: t + x), F.lit(0.0)

    def median(m: str) -> Column:
        return F.get(F.array_sort(fields[m]), F.floor(n / 2).cast("int"))

    def deviation(m: str) -> Column:
        mean = F.aggregate(fields[m], zero, add) / F.nullif(n, F.lit(0))
        return F.sqrt(F.aggregate(F.transform(fields[m], lambda x: (x - mean) * (x - mean)), zero, add) / F.nullif(n, F.lit(0)))

    made = {f"median_{m.removesuffix('_auto')}": median(m) for m in MEASURES} | {f"{m.removesuffix('_auto')}_std_dev": deviation(m) for m in MEASURES if m != "elongation"}
    made["flagged_fraction"] = F.size(F.filter(s, lambda e: e["flag"] != 0)) / F.nullif(n, F.lit(0))
    return {"count": n.cast("bigint")} | {k: F.coalesce(made[k], zero) for k in STATS}


def with_starless(frames: DataFrame, stats: DataFrame, frame: str) -> DataFrame:
    """Statistics of all frames; those of frames without stars are 0."""
    joined = frames.select(frame).join(stats, frame, "left")
    return joined.select(frame, *[F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) for c, t in stats.dtypes if c != frame])
