"""Backgrounds and per-pixel statistics over many frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringlake.operators.frames import strict
from ringlake.operators.outliers import mad_chunk_filter
from ringlake.operators.selection import radix_median

#: Fixed value: side of the square around the beam that statistics leave out.
CENTRE_BOX = 40


def mean_background(pixels: DataFrame, method: str = "mean") -> DataFrame:
    """(r, c, bg): per-pixel mean (or median) of all frames, null as soon as a frame misses the pixel.

    Means are added up in tasks before they are shuffled: one row a pixel and task. Medians
    are found by `radix_median`, which shuffles counts and keeps no pixel's values together.
    """
    if method not in ("mean", "median"):
        raise ValueError("method is mean or median")
    if method == "median":
        return radix_median(pixels, ("r", "c"), name="bg")
    return pixels.groupBy("r", "c").agg(strict(F.avg("v")).alias("bg"))


def filtered_background(pixels: DataFrame, chunk: int = 64, sigma: float = 8.0, beam: float = 5000, shape: tuple[int, int] | None = None) -> DataFrame:
    """(r, c, bg): frames cleaned chunk by chunk, then the per-pixel mean of what is left; gaps get the mean of all."""
    cleaned = mad_chunk_filter(pixels, chunk, sigma, beam, shape)
    return fill_missing(cleaned.groupBy("r", "c").agg(F.avg("v").alias("bg")))


def fill_missing(background: DataFrame) -> DataFrame:
    """Missing pixels of one frame get the mean of the others: one row of state, joined by broadcast."""
    mean = background.agg(F.avg("bg").alias("mean"))
    return background.join(F.broadcast(mean)).select("r", "c", F.coalesce("bg", "mean").alias("bg"))


def centre_box(statistics: DataFrame, x: float, y: float, size: int = CENTRE_BOX, columns: tuple[str, ...] = ("med", "mad")) -> DataFrame:
    """Statistics without those of the square of ``size`` around (x, y): its pixels are then never outliers."""
    half = size // 2
    edges = [F.rint(F.lit(v)).cast("int") for v in (x - half, x + half, y - half, y + half)]
    inside = (F.col("c") >= edges[0]) & (F.col("c") < edges[1]) & (F.col("r") >= edges[2]) & (F.col("r") < edges[3])
    return statistics.withColumns({c: F.when(~inside, F.col(c)) for c in columns})


def chosen_frames(listing: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """At most ``n`` rows of each group of ``listing`` (frame_id, xps_value, ...), in order of a hash: a sample that repeats.

    Spark keeps the first rows of a group in each task before it shuffles them.
    """
    order = Window.partitionBy("xps_value").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("frame_id")).cast("binary")), "frame_id")
    return listing.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n).drop("__k")


def sample_frames(frames: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """`chosen_frames` of whole frames: ids decide, then the frames follow."""
    return frames.join(chosen_frames(frames.select("frame_id", "xps_value"), n, seed).select("frame_id"), "frame_id", "left_semi")


def pixel_statistics(pixels: DataFrame) -> DataFrame:
    """(xps_value, r, c, med, mad): per group and pixel the median over frames and the median distance from it.

    Pixels are dealt out once, by (xps_value, r, c); both medians and the join between them
    use that partitioning. Meant for samples of frames (see sample_frames): a pixel's
    values of a group meet in one place.
    """
    keys = ["xps_value", "r", "c"]
    dealt = pixels.repartition(*keys)
    med = dealt.groupBy(*keys).agg(strict(F.median("v")).alias("med"))
    return dealt.join(med, keys).groupBy(*keys, "med").agg(strict(F.median(F.abs(F.col("v") - F.col("med")))).alias("mad"))


def mean_image(pixels: DataFrame, skip_missing: bool = False) -> DataFrame:
    """(xps_value, r, c, v): per-pixel mean of a group's processed frames; missing if any frame misses it, unless skipped."""
    mean = F.avg("v") if skip_missing else strict(F.avg("v"))
    return pixels.groupBy("xps_value", "r", "c").agg(mean.alias("v"))
