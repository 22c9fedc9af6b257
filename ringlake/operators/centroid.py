"""Pattern centres by intensity-weighted centroids in a ring.

Pixel form: one aggregate per frame. Frame form: array functions that iterate within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlake.functions.geometry import distance, half_even, in_ring, mask_centre
from ringlake.operators.frames import missing_as_null
from ringlake.operators.lookups import RING

# How long a centre is iterated, and the step that ends it.
MAX_ITERATIONS = 10
TOLERANCE = 1.0


def _with_guess(pixels: DataFrame, guess) -> DataFrame:
    """Columns gx, gy: of a pair of numbers, or of a table (frame_id, gx, gy)."""
    if isinstance(guess, DataFrame):
        return pixels.join(guess.select("frame_id", "gx", "gy"), "frame_id")
    return pixels.withColumns({"gx": F.lit(float(guess[0])), "gy": F.lit(float(guess[1]))})


def ring_centroid(pixels: DataFrame, guess, height: int, width: int, inner: float = RING[0], outer: float = RING[1]) -> DataFrame:
    """(frame_id, center_x, center_y, total_count): centroid of the ring around the rounded guess.

    The ring lies around the mask centre and the frame is moved under it by whole pixels, so
    what leaves the frame by that is lost. Without a known pixel in the ring the centre is
    the guess and the total 0; with a total of 0 or less it is the mask centre moved back.
    """
    mx, my = mask_centre(height, width)
    moved = _with_guess(pixels, guess).withColumns({"dx": half_even(F.col("gx") - mx), "dy": half_even(F.col("gy") - my)})
    at_c, at_r = F.col("c") - F.col("dx"), F.col("r") - F.col("dy")
    inside = at_c.between(0, width - 1) & at_r.between(0, height - 1) & in_ring(distance(at_r, at_c, mx, my), inner, outer)
    v = F.when(inside, F.col("v"))
    sums = moved.groupBy("frame_id").agg(F.first("gx").alias("gx"), F.first("gy").alias("gy"), F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * F.col("c")).alias("sx"), F.sum(v * F.col("r")).alias("sy"))

    def centre(g: str, m: int, s: str) -> Column:
        return F.when(F.col("n") == 0, F.col(g)).when(F.col("s") <= 0, m + F.rint(F.col(g) - m)).otherwise(F.col(s) / F.col("s"))

    return sums.select("frame_id", centre("gx", mx, "sx").alias("center_x"), centre("gy", my, "sy").alias("center_y"), F.coalesce("s", F.lit(0.0)).alias("total_count"))


def ring_centroid_exact(pixels: DataFrame, guess, inner: float = RING[0], outer: float = RING[1]) -> DataFrame:
    """(frame_id, center_x, center_y, total_count) with the ring around the unrounded guess.

    A missing pixel in the ring, or a total of 0 or less, leaves the guess; the total is
    then null where a pixel is missing.
    """
    near = in_ring(distance(F.col("r"), F.col("c"), F.col("gx"), F.col("gy")), inner, outer)
    v = F.when(near, F.col("v"))
    rows = _with_guess(pixels, guess).groupBy("frame_id").agg(F.first("gx").alias("gx"), F.first("gy").alias("gy"), F.count(v).alias("n"), F.count(F.when(near, 1)).alias("all"), F.sum(v).alias("s"), F.sum(v * F.col("c")).alias("sx"), F.sum(v * F.col("r")).alias("sy"))
    good = (F.col("n") == F.col("all")) & (F.col("s") > 0)
    total = F.when(F.col("n") == F.col("all"), F.coalesce("s", F.lit(0.0)))
    return rows.select("frame_id", F.when(good, F.col("sx") / F.col("s")).otherwise(F.col("gx")).alias("center_x"), F.when(good, F.col("sy") / F.col("s")).otherwise(F.col("gy")).alias("center_y"), total.alias("total_count"))


def _array_centroid(pixels: Column, height: Column, width: Column, gx: Column, gy: Column, inner: float, outer: float) -> Column:
    """struct(x, y, total) of ring_centroid for a row-major array of pixels."""
    mx, my = F.floor(width / 2), F.floor(height / 2)
    dx, dy = F.rint(gx - mx), F.rint(gy - my)
    zero = F.struct(F.lit(0).alias("n"), *[F.lit(0.0).alias(x) for x in ("s", "sx", "sy")])
    cells = F.transform(pixels, lambda v, p: F.struct(v.alias("v"), F.floor(p / width).alias("r"), (p % width).alias("c")))

    def add(a: Column, q: Column) -> Column:
        c, r = q["c"] - dx, q["r"] - dy
        inside = c.between(0, width - 1) & r.between(0, height - 1) & in_ring(distance(r, c, mx, my), inner, outer) & q["v"].isNotNull()
        more = F.struct((a["n"] + 1).alias("n"), (a["s"] + q["v"]).alias("s"), (a["sx"] + q["v"] * q["c"]).alias("sx"), (a["sy"] + q["v"] * q["r"]).alias("sy"))
        return F.when(inside, more).otherwise(a)

    def finish(a: Column) -> Column:
        def centre(g: Column, rounded: Column, s: Column) -> Column:
            return F.when(a["n"] == 0, g).when(a["s"] <= 0, rounded).otherwise(s / a["s"])

        return F.struct(centre(gx, mx + dx, a["sx"]).alias("x"), centre(gy, my + dy, a["sy"]).alias("y"), a["s"].alias("total"))

    return F.aggregate(cells, zero, add, finish)


def centroid_trace(frames: DataFrame, guess: tuple[float, float], inner: float = RING[0], outer: float = RING[1], max_iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """The frames with ``trace``: the centres of every step, the guess first, each with the total of its ring.

    A step that moves the centre by less than ``tolerance`` is the last. One more centroid
    around that centre, the last entry, gives the result and its total. Rows are independent:
    no shuffle. For frames of a million pixels the kernels of the frame path are faster.
    """
    start = F.struct(F.lit(float(guess[0])).alias("x"), F.lit(float(guess[1])).alias("y"), F.lit(0.0).alias("total"))

    def around(at: Column) -> Column:
        return _array_centroid(F.col("pixels"), F.col("height"), F.col("width"), at["x"], at["y"], inner, outer)

    def step(state: Column, _: Column) -> Column:
        here = F.element_at(state["path"], -1)

        def move(q: Column) -> Column:
            far = F.sqrt(F.pow(q["x"] - here["x"], 2) + F.pow(q["y"] - here["y"], 2)) >= tolerance
            return F.struct(F.concat(state["path"], F.array(q)).alias("path"), (~far).alias("done"))

        # the array of one element evaluates the centroid once
        moved = F.element_at(F.transform(F.array(around(here)), move), 1)
        return F.when(state["done"], state).otherwise(moved)

    first = F.struct(F.array(start).alias("path"), F.lit(False).alias("done"))
    # the last centroid is part of the fold's end, where the path is bound: a column would be computed again for each pixel
    trace = F.aggregate(F.sequence(F.lit(1), F.lit(max_iterations)), first, step, lambda s: F.concat(s["path"], F.array(around(F.element_at(s["path"], -1)))))
    return frames.withColumn("trace", trace)


def iterative_centroid(frames: DataFrame, guess: tuple[float, float], **options) -> DataFrame:
    """(frame_id, center_x, center_y, total_count, n_steps): the end of centroid_trace."""
    last = centroid_trace(missing_as_null(frames), guess, **options).withColumn("last", F.element_at("trace", -1))
    return last.select("frame_id", F.col("last.x").alias("center_x"), F.col("last.y").alias("center_y"), F.col("last.total").alias("total_count"), (F.size("trace") - 1).alias("n_steps"))
