"""Rejection of pixels that X-rays hit. Removed pixels are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlake.operators.frames import subtract
from ringlake.operators.morphology import dilated

# Default thresholds, in deviations and counts.
SIGMA = 29.6
GROW_RATIO = 0.7
CHUNK_GROW_RATIO = 0.75
CHUNK_BEAM = 300
CLIP_SIGMA = 5.0
CLIP_BEAM = 5000


def require_divisible(height: int, width: int, chunk: int) -> None:
    if height % chunk or width % chunk:
        raise ValueError(f"a frame of {height} x {width} has no whole chunks of {chunk}")


def chunks(chunk: int) -> tuple[Column, Column, Window]:
    """Chunk coordinates and the window of a chunk's pixels."""
    a, b = F.floor(F.col("r") / chunk), F.floor(F.col("c") / chunk)
    return a, b, Window.partitionBy("frame_id", a, b)


def _whole_chunks(chunk: int, shape: tuple[int, int] | None) -> None:
    if chunk < 1:
        raise ValueError("a chunk has one pixel at least")
    if shape is not None:
        require_divisible(*shape, chunk)


def _of_whole_chunk(chunk: int, w: Window) -> Column:
    """v, or an error at run time where the frame ends inside a chunk."""
    text = F.concat(F.lit("frame "), F.col("frame_id").cast("string"), F.lit(f" has no whole chunks of {chunk}"))
    return F.when(F.count(F.lit(1)).over(w) == chunk * chunk, F.col("v")).otherwise(F.raise_error(text).cast("double"))


def mad_chunk_filter(pixels: DataFrame, chunk: int = 32, sigma: float = SIGMA, beam: float = CHUNK_BEAM, shape: tuple[int, int] | None = None) -> DataFrame:
    """Median and unscaled MAD per chunk; where any pixel exceeds med + sigma mad, all above med + 0.75 sigma mad go.

    Chunks brighter than ``beam`` (in the median) and chunks with a missing pixel stay as they are.
    A frame that isn't made of whole chunks is an error at run time, or at once where its
    ``shape`` (height, width) is given.
    """
    _whole_chunks(chunk, shape)
    *_, w = chunks(chunk)
    pixels = pixels.withColumn("v", _of_whole_chunk(chunk, w))
    whole = F.count("v").over(w) == F.count(F.lit(1)).over(w)
    first = pixels.withColumn("med", F.median("v").over(w)).withColumn("ok", whole)
    second = first.withColumn("mad", F.median(F.abs(F.col("v") - F.col("med"))).over(w))
    hit = F.max((F.col("v") > F.col("med") + sigma * F.col("mad")).cast("int")).over(w) == 1
    third = second.withColumn("hit", hit & F.col("ok") & (F.col("med") <= beam))
    gone = F.col("hit") & (F.col("v") > F.col("med") + CHUNK_GROW_RATIO * sigma * F.col("mad"))
    return third.withColumn("v", F.when(~F.coalesce(gone, F.lit(False)), F.col("v"))).drop("med", "mad", "ok", "hit")


def sigma_chunk_filter(pixels: DataFrame, chunk: int = 64, sigma: float = CLIP_SIGMA, beam: float = CLIP_BEAM, shape: tuple[int, int] | None = None) -> DataFrame:
    """Mean and population deviation per chunk; pixels above mean + sigma std go. Adds ``removed``; v keeps the value.

    Chunks brighter than ``beam`` in the mean stay as they are. A frame that isn't made of
    whole chunks is an error at run time, or at once where its ``shape`` (height, width) is given.
    """
    _whole_chunks(chunk, shape)
    *_, w = chunks(chunk)
    pixels = pixels.withColumn("v", _of_whole_chunk(chunk, w))
    mean, std = F.avg("v").over(w), F.stddev_pop("v").over(w)
    gone = (mean <= beam) & (F.col("v") > mean + sigma * std)
    return pixels.withColumn("removed", F.coalesce(gone, F.lit(False)))


def hysteresis_filter(pixels: DataFrame, statistics: DataFrame, sigma: float = SIGMA, ratio: float = GROW_RATIO) -> DataFrame:
    """Pixels above med + sigma mad, and their four neighbours above med + sigma ratio mad, go.

    ``statistics`` is (xps_value, r, c, med, mad), one row per group and pixel; where it is
    null nothing is removed. Statistics of a single group may be broadcast by the caller.
    """
    return reject_hits(pixels.join(statistics, ["xps_value", "r", "c"], "left"), sigma, ratio)


def reject_hits(known: DataFrame, sigma: float = SIGMA, ratio: float = GROW_RATIO) -> DataFrame:
    """`hysteresis_filter` of pixels that have their med and mad beside them: no join, no shuffle of pixels dealt out by frame."""
    high = known.withColumn("hit", F.coalesce(F.col("v") > F.col("med") + sigma * F.col("mad"), F.lit(False)))
    grown = high.withColumn("near", dilated("hit"))
    gone = F.col("near") & (F.col("v") > F.col("med") + sigma * ratio * F.col("mad"))
    return grown.select("frame_id", "xps_value", "r", "c", F.when(~F.coalesce(gone, F.lit(False)), F.col("v")).alias("v"))


def remove_background(pixels: DataFrame, background: DataFrame, statistics: DataFrame, sigma: float = SIGMA, ratio: float = GROW_RATIO) -> DataFrame:
    """Subtract the background, then hysteresis_filter."""
    return hysteresis_filter(subtract(pixels, background), statistics, sigma, ratio)
