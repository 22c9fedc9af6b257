"""Radial profiles: means over half-open rings of equal width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlake.functions.geometry import distance, half_even, mask_centre, radial_bin
from ringlake.functions.naming import WIDE_BIN
from ringlake.operators.frames import strict
from ringlake.operators.lookups import DISC


def _complete(binned: DataFrame, mean: Column, bins: int) -> DataFrame:
    """(frame_id, bin, mean) for every bin of every frame in ``binned`` (frame_id, bin, v), where a null bin counts for none: bins are generated, not joined."""
    means = binned.groupBy("frame_id", "bin").agg(mean.alias("mean"))
    held = means.groupBy("frame_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "mean")))).alias("m"))
    return held.select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "m").select("frame_id", "bin", F.col("m")[F.col("bin")].alias("mean"))


def azimuthal_average(pixels: DataFrame, centres: DataFrame, height: int, width: int, radius: float = DISC[0], bins: int = DISC[1]) -> DataFrame:
    """(frame_id, bin, bin_center, mean) around the rounded centre; missing pixels are skipped, empty bins null.

    ``centres`` is (frame_id, center_x, center_y); all bins of each of its frames are there,
    with or without pixels. The frame is moved by whole pixels under bins around the mask
    centre; pixels that leave the frame by that are lost.
    """
    mx, my = mask_centre(height, width)
    placed = centres.select("frame_id", "center_x", "center_y").join(pixels, "frame_id", "left")
    c, r = F.col("c") - half_even(F.col("center_x") - mx), F.col("r") - half_even(F.col("center_y") - my)
    inside = c.between(0, width - 1) & r.between(0, height - 1)
    full = _complete(placed.select("frame_id", F.when(inside, radial_bin(distance(r, c, mx, my), radius, bins)).alias("bin"), "v"), F.avg("v"), bins)
    step = radius / bins
    return full.select("frame_id", "bin", ((F.col("bin") * step + (F.col("bin") + 1) * step) / 2).alias("bin_center"), "mean")


def centred_profiles(pixels: DataFrame, height: int, width: int, radius: float = DISC[0], bins: int = DISC[1]) -> DataFrame:
    """(frame_id, center_x, center_y, total_count, radial_profile) of pixels that carry those of their frame.

    The means of `azimuthal_average`, as an array, without a join: every frame has its row.
    """
    mx, my = mask_centre(height, width)
    c, r = F.col("c") - half_even(F.col("center_x") - mx), F.col("r") - half_even(F.col("center_y") - my)
    inside = c.between(0, width - 1) & r.between(0, height - 1)
    own = ["frame_id", "center_x", "center_y", "total_count"]
    means = pixels.groupBy(*own, F.when(inside, radial_bin(distance(r, c, mx, my), radius, bins)).alias("bin")).agg(F.avg("v").alias("mean"))
    held = means.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "mean")))).alias("m"))
    return held.select(*own, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.col("m")[i]).alias("radial_profile"))


def azimuthal_average_exact(pixels: DataFrame, centres: DataFrame, radius: float = 300, bins: int = 300) -> DataFrame:
    """(frame_id, bin, bin_center, mean) around the unrounded centre; a missing pixel makes its bin null, empty bins are 0.

    All bins of every frame of ``centres``, with or without pixels.
    """
    placed = centres.select("frame_id", "center_x", "center_y").join(pixels, "frame_id", "left")
    d = distance(F.col("r"), F.col("c"), F.col("center_x"), F.col("center_y"))
    full = _complete(placed.select("frame_id", radial_bin(d, radius, bins).alias("bin"), "v"), F.struct(strict(F.avg("v")).alias("mean")), bins)
    step = radius / bins
    return full.select("frame_id", "bin", ((F.col("bin") * step + (F.col("bin") + 1) * step) / 2).alias("bin_center"), F.when(F.col("mean").isNull(), 0.0).otherwise(F.col("mean.mean")).alias("mean"))


def as_array(profiles: DataFrame) -> DataFrame:
    """(frame_id, radial_profile): the means in order of their bins."""
    return profiles.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "mean"))), lambda x: x["mean"]).alias("radial_profile"))


def wide(results: DataFrame, bins: int, name: str = WIDE_BIN) -> DataFrame:
    """radial_profile as a column per bin; the other columns stay."""
    return results.select(*[F.col(c) for c in results.columns if c != "radial_profile"], *[F.get("radial_profile", F.lit(i)).alias(name.format(i)) for i in range(bins)])


def profile_statistics(profiles: DataFrame) -> DataFrame:
    """(xps_value, bin, mean, std): over the frames of a group, population deviation, null if any frame misses the bin."""
    return profiles.groupBy("xps_value", "bin").agg(strict(F.avg("mean"), "mean").alias("mean"), strict(F.stddev_pop("mean"), "mean").alias("std"))
