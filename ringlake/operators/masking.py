"""Drift removal and signal masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlake.operators.frames import of_frame


def apply_masks(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """Subtract each frame's drift and drop the pixels outside the signal mask.

    ``masks`` is (r, c, keep, bkg), one frame in size and so broadcast. The drift is the mean
    of a frame's known pixels with bkg = 0; without any, the whole frame becomes missing.
    """
    known = pixels.join(F.broadcast(masks.select("r", "c", "keep", "bkg")), ["r", "c"])
    drift = F.avg(F.when(F.col("bkg") == 0, F.col("v"))).over(of_frame())
    kept = known.withColumn("drift", drift)
    return kept.select("frame_id", "xps_value", "r", "c", F.when(F.col("keep") == 1, F.col("v") - F.col("drift")).alias("v"))
