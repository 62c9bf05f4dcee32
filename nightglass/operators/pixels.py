"""Pixel arrays: normalisation, statistics and a simple background mesh.

Full frames stay arrays, as one row each; only small ones are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightglass.functions import scalars as X


def doubles(pixels: Column | str) -> Column:
    return F.transform(X.col(pixels), lambda p: p.cast("double"))


def normalize_pixels(pixels: Column | str) -> Column:
    """(p - min) / (max - min) with NaN left out of both; zeros where all are equal."""
    px = doubles(pixels)
    some = F.filter(px, lambda p: ~F.isnan(p))
    low, high = F.array_min(some), F.array_max(some)
    return F.transform(px, lambda p: F.when(high == low, F.lit(0.0)).otherwise((p - low) / F.nullif(high - low, F.lit(0.0))))


def has_nonfinite(pixels: Column | str) -> Column:
    """Whether a pixel is NaN or infinite: such a frame isn't searched for stars."""
    return F.exists(doubles(pixels), lambda p: ~X.finite(p))


def pixel_stats(pixels: Column | str) -> Column:
    """Least and greatest of the finite pixels, and their sum over the number of all pixels."""
    px = doubles(pixels)
    good = F.filter(px, X.finite)
    total = F.aggregate(good, F.lit(0.0), lambda s, p: s + p)
    n = F.size(px)
    return F.struct(F.array_min(good).alias("min"), F.array_max(good).alias("max"), F.when(n > 0, total / F.nullif(n, F.lit(0))).alias("mean"))


def explode_pixels(frames: DataFrame, frame: str, pixels: str, width: int) -> DataFrame:
    """(frame, y, x, value) of small frames."""
    flat = frames.select(frame, F.posexplode(doubles(pixels)).alias("_i", "value"))
    return flat.select(frame, F.floor(F.col("_i") / width).cast("int").alias("y"), (F.col("_i") % width).cast("int").alias("x"), "value")


def background_cells(frames: DataFrame, frame: str, pixels: str, width: int, cell: int) -> DataFrame:
    """Mean, deviation, least and greatest of each cell of ``cell`` by ``cell`` pixels."""
    px = explode_pixels(frames, frame, pixels, width)
    grouped = px.groupBy(frame, F.floor(F.col("y") / cell).cast("int").alias("cell_y"), F.floor(F.col("x") / cell).cast("int").alias("cell_x"))
    return grouped.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("rms"), F.min("value").alias("min"), F.max("value").alias("max"))
