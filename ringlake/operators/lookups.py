"""Lookup tables of one row per detector pixel: rings, radial bins, masks.

Their size is that of one frame, known before any data are read, so they may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlake.functions.geometry import distance, in_ring, mask_centre, radial_bin

# Default ring, disc and mask sizes in pixels.
RING = (40, 200)
DISC = (512, 512)
CORNER = 20


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    p = F.col("id")
    return spark.range(height * width).select(F.floor(p / width).cast("int").alias("r"), (p % width).cast("int").alias("c"))


def _centred(spark: SparkSession, height: int, width: int) -> DataFrame:
    x, y = mask_centre(height, width)
    return grid(spark, height, width).withColumn("d", distance(F.col("r"), F.col("c"), x, y))


def ring(spark: SparkSession, height: int, width: int, inner: float = RING[0], outer: float = RING[1]) -> DataFrame:
    """(r, c, d) of the pixels in the closed ring around the mask centre."""
    return _centred(spark, height, width).where(in_ring(F.col("d"), inner, outer))


def radial(spark: SparkSession, height: int, width: int, radius: float = DISC[0], bins: int = DISC[1]) -> DataFrame:
    """(r, c, bin) of the pixels closer to the mask centre than radius."""
    return _centred(spark, height, width).select("r", "c", radial_bin(F.col("d"), radius, bins).alias("bin")).where("bin IS NOT NULL")


def bin_counts(spark: SparkSession, height: int, width: int, radius: float = DISC[0], bins: int = DISC[1]) -> DataFrame:
    """(bin, n_pixels, pixel_index) of the bins that have pixels; pixel_index is r * width + c, ascending."""
    cells = radial(spark, height, width, radius, bins).withColumn("p", F.col("r") * width + F.col("c"))
    return cells.groupBy("bin").agg(F.count("*").alias("n_pixels"), F.array_sort(F.collect_list("p")).alias("pixel_index"))


def bin_centres(spark: SparkSession, radius: float = DISC[0], bins: int = DISC[1]) -> DataFrame:
    """(bin, bin_center) of all bins."""
    step = radius / bins
    i = F.col("id")
    return spark.range(bins).select(i.cast("int").alias("bin"), ((i * step + (i + 1) * step) / 2).alias("bin_center"))


def corner_masks(spark: SparkSession, height: int, width: int, margin: int = CORNER) -> DataFrame:
    """(r, c, keep, bkg): keep every pixel; the drift sample (bkg = 0) is the four corners."""
    outside = [(F.col(x) < margin) | (F.col(x) >= n - margin) for x, n in (("r", height), ("c", width))]
    return grid(spark, height, width).withColumn("keep", F.lit(1)).withColumn("bkg", F.when(outside[0] & outside[1], 0).otherwise(1))


def threshold_mask(pixels: DataFrame, level: int = 128) -> DataFrame:
    """1 where a grey value reaches the level, else 0."""
    return pixels.select("frame_id", "r", "c", (F.col("v") >= level).cast("int").alias("mask"))


def combine(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union and intersection of two masks (r, c, keep)."""
    both = a.select("r", "c", F.col("keep").alias("a")).join(b.select("r", "c", F.col("keep").alias("b")), ["r", "c"])
    return both.select("r", "c", F.greatest("a", "b").alias("either"), F.least("a", "b").alias("both"))
