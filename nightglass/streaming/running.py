"""Running statistics of frames as they arrive: an extension.

Frames come as a stream of files or rows; the state is one row for each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_stats(frames: DataFrame, time: str, value: str, group: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and deviation of each group in windows of event time; later frames than ``late`` are dropped."""
    return frames.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), group).agg(F.count(F.lit(1)).alias("frames"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_dev")).select(F.col("w.start").alias("start"), group, "frames", "mean", "std_dev")


def enough(stats: DataFrame, gain: float = 0.01) -> DataFrame:
    """Add ``stop``: whether one more frame would lower the mean's error, which falls as 1 / sqrt(n), by less than ``gain``."""
    n = F.col("frames").cast("double")
    return stats.withColumn("stop", F.lit(1.0) - F.sqrt(n / (n + 1)) < gain)
