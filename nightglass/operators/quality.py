"""Quality scores of frames, from star statistics and the background."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightglass.functions import scalars as X
from nightglass.functions.scalars import QualityWeights


def background(median: Column, rms: Column, least: Column | None = None, most: Column | None = None) -> Column:
    """A background struct; without a mesh its least and greatest are 0 and its uniformity 1."""
    u = F.lit(1.0) if least is None else X.uniformity(least, most)
    zero = F.lit(0.0)
    return F.struct(median.alias("median"), rms.alias("rms"), (zero if least is None else least).alias("min"), (zero if most is None else most).alias("max"), u.alias("uniformity"))


def background_stats(values: DataFrame, frame: str, value: str) -> DataFrame:
    """Upper median, deviation, least, greatest and uniformity of each frame's background values."""
    from nightglass.operators.stars import upper_median

    some = F.when(~F.isnan(value), F.col(value))
    made = values.groupBy(frame).agg(upper_median(value).alias("bg_median"), F.stddev_pop(value).alias("bg_rms"), F.min(some).alias("bg_min"), F.max(some).alias("bg_max"))
    return made.withColumn("bg_uniformity", X.uniformity("bg_min", "bg_max"))


def scores(weights: QualityWeights = QualityWeights()) -> dict[str, Column]:
    """Score columns by name, from star statistics and bg_uniformity, bg_rms."""
    parts = {
        "fwhm": X.fwhm_score("median_fwhm", "fwhm_std_dev"), "eccentricity": X.eccentricity_score("median_elongation"), "background": X.background_score("bg_uniformity", "bg_rms"),
        "kron": X.kron_score("median_kron_radius"), "snr": X.snr_score("median_snr"), "flag": X.flag_score("flagged_fraction"),
    }
    return {f"{k}_score": v for k, v in parts.items()} | {"overall_score": X.overall_score(parts, weights)}


def quality_scores(frames: DataFrame, weights: QualityWeights = QualityWeights(), clamp: bool = False) -> DataFrame:
    """Add the six scores and the overall one; ``clamp`` holds them in 0 to 1, which a starless frame's otherwise leave."""
    made = scores(weights)
    if clamp:
        made = {k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for k, v in made.items()}
    return frames.withColumns(made)


def frame_metrics(frames: DataFrame, path: str, weights: QualityWeights = QualityWeights(), keep: Sequence[str] = ()) -> DataFrame:
    """The ``keep`` columns, frame_id, star_stats, background and scores, the last three as structs; a row for each of ``frames``."""
    from nightglass.functions.text import frame_id
    from nightglass.operators.stars import STATS

    scored = quality_scores(frames, weights)
    return scored.select(
        *keep,
        frame_id(path).alias("frame_id"),
        F.struct("count", *STATS).alias("star_stats"),
        F.struct(*[F.col(f"bg_{c}").alias(c) for c in ("median", "rms", "min", "max", "uniformity")]).alias("background"),
        F.struct(*[F.col(f"{p}_score").alias(p) for p in (*X.PARTS, "overall")]).alias("scores"),
    )


def ranking(frames: DataFrame, n: int, by: str = "overall_score", tie: str = "frame_id") -> DataFrame:
    """The ``n`` best frames."""
    return frames.orderBy(F.desc(by), tie).limit(n)


def reject_outliers(frames: DataFrame, column: str, k: float = 3.0) -> DataFrame:
    """Frames within ``k`` median absolute deviations of the median of ``column``: an extension.

    Both medians are single rows, so the joins are with broadcasts of one row.
    """
    centre = frames.agg(F.expr(f"percentile(`{column}`, 0.5)").alias("_median"))
    with_centre = frames.join(F.broadcast(centre))
    spread = with_centre.agg(F.expr(f"percentile(abs(`{column}` - _median), 0.5)").alias("_mad"))
    return with_centre.join(F.broadcast(spread)).filter(F.abs(F.col(column) - F.col("_median")) <= F.lit(k) * F.col("_mad")).drop("_median", "_mad")


def percentile_score(frames: DataFrame, column: str, low: float = 0.05, high: float = 0.95, out: str = "score") -> DataFrame:
    """``column`` between its percentiles as 0 to 1: an extension."""
    bounds = frames.agg(F.expr(f"percentile(`{column}`, {low})").alias("_low"), F.expr(f"percentile(`{column}`, {high})").alias("_high"))
    part = (F.col(column) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    return frames.join(F.broadcast(bounds)).withColumn(out, F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)), F.lit(0.0))).drop("_low", "_high")


def accepted(frames: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Frames whose columns are inside (least, greatest) limits: an extension."""
    for column, (least, most) in limits.items():
        if least is not None:
            frames = frames.filter(F.col(column) >= least)
        if most is not None:
            frames = frames.filter(F.col(column) <= most)
    return frames
