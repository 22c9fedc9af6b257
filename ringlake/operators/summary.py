"""Reductions that report on frames, groups and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlake.operators.frames import strict


def run_summary(results: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Per group: frames, mean and deviation of centres and counts, extremes of profiles; with ``failed``, the success rate."""
    extremes = results.withColumns({"hi": F.array_max("radial_profile"), "lo": F.array_min("radial_profile")})
    out = extremes.groupBy("xps_value").agg(
        F.count("*").alias("n_frames"),
        *[f(x).alias(f"{n}_{x}") for x in ("center_x", "center_y", "total_count") for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
        F.max("hi").alias("profile_max"), F.min("lo").alias("profile_min"),
    )
    if failed is None:
        return out
    lost = failed.groupBy("xps_value").agg(F.count("*").alias("n_failed"))
    both = out.join(lost, "xps_value", "full").withColumns({"n_frames": F.coalesce("n_frames", F.lit(0)), "n_failed": F.coalesce("n_failed", F.lit(0))})
    return both.withColumn("success_rate", F.col("n_frames") / (F.col("n_frames") + F.col("n_failed")))


def corner_statistics(pixels: DataFrame, height: int, width: int, size: int) -> DataFrame:
    """(frame_id, corner, mean, std, lowest, highest) of the four corner boxes."""
    row = F.when(F.col("r") < size, "top").when(F.col("r") >= height - size, "bottom")
    col = F.when(F.col("c") < size, "left").when(F.col("c") >= width - size, "right")
    boxed = pixels.withColumn("corner", F.concat(row, F.lit("_"), col)).where("corner IS NOT NULL")
    return boxed.groupBy("frame_id", "corner").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("lowest"), F.max("v").alias("highest"))


def slice_profile(pixels: DataFrame, first: int, last: int) -> DataFrame:
    """(frame_id, r, mean, std) over the columns first to last - 1 of each row."""
    return pixels.where((F.col("c") >= first) & (F.col("c") < last)).groupBy("frame_id", "r").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def reductions(pixels: DataFrame) -> DataFrame:
    """Elementary reductions of each frame: known pixels only, and (strict) null if one is missing."""
    return pixels.groupBy("frame_id").agg(
        F.count("*").alias("n"), F.count("v").alias("n_known"), F.sum("v").alias("total"), F.avg("v").alias("mean"), F.median("v").alias("median"),
        F.stddev_pop("v").alias("std"), F.min("v").alias("lowest"), F.max("v").alias("highest"), strict(F.sum("v")).alias("strict_total"), F.bool_or(F.col("v").isNull()).alias("any_missing"),
    )
