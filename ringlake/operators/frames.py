"""Frames as rows of arrays, and as one row per pixel.

frames: frame_id, xps_value, height, width, pixels (array<double>, row-major)
pixels: frame_id, xps_value, r, c, v (null = missing)

A frame's pixels stay in the partition of its frame: frames are dealt out once, as arrays,
and windows and aggregates over (frame_id, ...) then need no shuffle of pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def of_frame() -> WindowSpec:
    """The window of a frame's pixels."""
    return Window.partitionBy("frame_id")


def missing_as_null(frames: DataFrame) -> DataFrame:
    """NaN pixels become null: comparisons with missing values are then never true."""
    return frames.withColumn("pixels", F.transform("pixels", lambda v: F.nanvl(v.cast("double"), F.lit(None).cast("double"))))


def shape_error(height: int, width: int) -> Column:
    """Why a frame can't be processed, null where it can: no pixels, or not height x width of them."""
    size = F.format_string(f"a frame of %d x %d pixels, not {height} x {width}", "height", "width")
    count = F.format_string(f"%d pixels, not {height} x {width}", F.size("pixels"))
    other = F.coalesce((F.col("height") != height) | (F.col("width") != width), F.lit(True))
    return F.when(F.col("pixels").isNull(), "a frame without pixels").when(other, F.coalesce(size, F.lit("a frame without a shape"))).when(F.size("pixels") != height * width, count)


def checked(frames: DataFrame, height: int, width: int) -> DataFrame:
    """The frames with ``error``: their own if they have one, else that of their shape."""
    own = F.col("error").cast("string") if "error" in frames.columns else F.lit(None).cast("string")
    return frames.withColumn("error", F.coalesce(own, shape_error(height, width)))


def require_pixels(frames: DataFrame) -> DataFrame:
    """The frames, or an error at run time if one has no pixels."""
    return frames.withColumn("pixels", F.coalesce("pixels", F.raise_error(F.lit("a frame has no pixels")).cast("array<double>")))


def to_pixels(frames: DataFrame, deal: bool = True, beside: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """One row per pixel, in the partition of its frame; frames without pixels give none.

    ``beside`` are arrays as long as pixels, of which each row gets its own element (null
    arrays give null); ``carry`` are columns of the frame that its rows keep.

    ``deal`` first spreads the frames by frame_id, which windows of a frame need; means over
    frames don't.
    """
    dealt = missing_as_null(frames)
    dealt = dealt.repartition("frame_id") if deal else dealt
    place = [F.floor(F.col("p") / F.col("width")).cast("int").alias("r"), (F.col("p") % F.col("width")).cast("int").alias("c")]
    if beside:
        arrays = [F.coalesce(c, F.array_repeat(F.lit(None).cast("double"), F.size("pixels"))).alias(c) for c in beside]
        rows = dealt.select("frame_id", "xps_value", "width", *carry, F.posexplode(F.arrays_zip(F.col("pixels").alias("v"), *arrays)).alias("p", "x"))
        return rows.select("frame_id", "xps_value", *place, "x.v", *[f"x.{c}" for c in beside], *carry)
    rows = dealt.select("frame_id", "xps_value", "width", *carry, F.posexplode("pixels").alias("p", "v"))
    return rows.select("frame_id", "xps_value", *place, "v", *carry)


def to_frames(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """The inverse of to_pixels; pixels without a row are null. A pixel that is there twice, or outside, is an error.

    Values are sorted by place; the nulls between two known places are as many as their
    numbers leave out, so the work grows with the pixels alone.
    """
    listed = pixels.groupBy("frame_id", "xps_value").agg(F.array_sort(F.collect_list(F.struct((F.col("r") * width + F.col("c")).alias("p"), "v"))).alias("s"))
    nothing = lambda n: F.array_repeat(F.lit(None).cast("double"), n)
    before = lambda i: F.coalesce(F.get("s", i - 1)["p"], F.lit(-1))
    gaps = F.flatten(F.transform("s", lambda x, i: F.concat(nothing(x["p"] - before(i) - 1), F.array(x["v"]))))
    end = nothing(F.lit(height * width - 1) - F.element_at("s", -1)["p"])
    whole = (F.size("s") == height * width) & (F.element_at("s", 1)["p"] == 0) & (F.element_at("s", -1)["p"] == height * width - 1)
    filled = F.when(whole, F.col("s")["v"]).otherwise(F.concat(gaps, end))
    sized = listed.select("frame_id", "xps_value", filled.alias("pixels"))
    error = F.raise_error(F.concat(F.lit("not one value for each pixel of frame "), F.col("frame_id").cast("string"))).cast("array<double>")
    exact = F.when(F.size("pixels") == height * width, F.col("pixels")).otherwise(error)
    return sized.select("frame_id", "xps_value", F.lit(height).alias("height"), F.lit(width).alias("width"), exact.alias("pixels"))


def require_one_shape(frames: DataFrame) -> DataFrame:
    """The frames, or an error at run time if their shapes differ."""
    shapes = frames.agg(F.min(F.struct("height", "width")).alias("a"), F.max(F.struct("height", "width")).alias("b"))
    same = shapes.select(F.when(F.col("a").eqNullSafe(F.col("b")), True).otherwise(F.raise_error(F.lit("frames differ in shape"))).alias("ok"))
    return frames.join(F.broadcast(same), F.col("ok"), "left").drop("ok")


def strict(aggregate: Column, value: str = "v") -> Column:
    """An aggregate that is null as soon as one value is missing."""
    return F.when(F.count(value) == F.count(F.lit(1)), aggregate)


def subtract(pixels: DataFrame, background: DataFrame) -> DataFrame:
    """v minus the background (r, c, bg) of the same pixel; a frame-sized table is broadcast."""
    more = [c for c in pixels.columns if c not in ("frame_id", "xps_value", "r", "c", "v")]
    return pixels.join(F.broadcast(background.select("r", "c", "bg")), ["r", "c"]).select("frame_id", "xps_value", "r", "c", (F.col("v") - F.col("bg")).alias("v"), *more)


def shift(pixels: DataFrame, dx: Column | int, dy: Column | int, height: int, width: int) -> DataFrame:
    """Pixels moved by whole steps (-dx, -dy); those that leave the frame are dropped. Only coordinates change."""
    c, r = F.col("c") - dx, F.col("r") - dy
    inside = c.between(0, width - 1) & r.between(0, height - 1)
    return pixels.where(inside).withColumns({"c": c.cast("int"), "r": r.cast("int")})


def normalise(pixels: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """v clamped to [low, high] (a frame's own range where not given) and scaled to 0..1; 0 for a constant frame."""
    lo = F.lit(low) if low is not None else F.min("v").over(of_frame())
    hi = F.lit(high) if high is not None else F.max("v").over(of_frame())
    known = pixels.withColumn("lo", lo).withColumn("hi", hi)
    scaled = (F.least(F.greatest("v", "lo"), "hi") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return known.withColumn("v", F.when(F.col("v").isNull(), F.lit(None)).otherwise(F.coalesce(scaled, F.lit(0.0)))).drop("lo", "hi")
