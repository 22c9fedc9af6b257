"""From frames to results: the whole chain in three physical forms with one meaning.

The pixel path is declarative, a row per pixel; the frame path keeps a frame in one row and
runs small array kernels on it, a frame at a time, for frames of a million pixels; the block
path cuts frames into blocks, which clean one frame in many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ringlake.functions.geometry import mask_centre
from ringlake.operators import background as bg
from ringlake.operators import centroid, grouping, lookups, radial
from ringlake.operators.blocks import SIDE, Layout, from_blocks, marked_blocks, rejected_blocks, table_blocks, to_blocks
from ringlake.operators.frames import checked, subtract, to_frames, to_pixels
from ringlake.operators.masking import apply_masks
from ringlake.operators.outliers import reject_hits, remove_background
from ringlake.sources.formats import pieces
from ringlake.sources.results import save_failures, save_results
from ringlake.sources.tiff import list_files, read_frames

RESULT = "frame_id long, filename string, xps_value double, center_x double, center_y double, total_count double, radial_profile array<double>, error string"


@dataclass(frozen=True)
class Settings:
    """Shape of the detector and parameters of all steps."""

    height: int
    width: int
    guess: tuple[float, float]
    ring: tuple[float, float] = lookups.RING
    radius: float = lookups.DISC[0]
    bins: int = lookups.DISC[1]
    sigma: float = 29.6
    ratio: float = 0.7
    sample: int = 50
    box: int = bg.CENTRE_BOX
    max_iterations: int = centroid.MAX_ITERATIONS
    tolerance: float = centroid.TOLERANCE
    seed: int = 0

    def __post_init__(self) -> None:
        """Parameters that no frame could be processed with are refused before a plan is made."""
        good = {
            "height and width must be 1 or more": self.height >= 1 and self.width >= 1,
            "a ring has 0 <= inner <= outer": 0 <= self.ring[0] <= self.ring[1],
            "radius and bins must be above 0": self.radius > 0 and self.bins >= 1,
            "sigma must be above 0 and ratio from 0 to 1": self.sigma > 0 and 0 <= self.ratio <= 1,
            "sample, max_iterations and box must be 1, 0 and 0 or more": self.sample >= 1 and self.max_iterations >= 0 and self.box >= 0,
            "tolerance must be 0 or more": self.tolerance >= 0,
        }
        for what, holds in good.items():
            if not holds:
                raise ValueError(what)


def statistics(sampled: DataFrame, background: DataFrame, s: Settings) -> DataFrame:
    """(xps_value, r, c, med, mad) of each group's frames in ``sampled``, after subtraction, without the beam's box."""
    pixels = subtract(to_pixels(sampled, deal=False), background)
    return bg.centre_box(bg.pixel_statistics(pixels), s.guess[0], s.guess[1], s.box)


def _sample(good: DataFrame, sampled: DataFrame | None, s: Settings) -> DataFrame:
    """The frames for the statistics: a sample of the good ones, or the good ones of a given sample."""
    return bg.sample_frames(good, s.sample, s.seed) if sampled is None else checked(sampled, s.height, s.width).where("error IS NULL")


def with_statistics(frames: DataFrame, sampled: DataFrame, background: DataFrame, s: Settings, salts: int) -> DataFrame:
    """The frames with ``med`` and ``mad`` of ``sampled``, arrays of their group, which is one row.

    Each group is split into ``salts`` parts and its row repeated for each, so a group of any
    size spreads over tasks.
    """
    place = (F.col("r") * s.width + F.col("c")).alias("p")
    arrays = statistics(sampled, background, s).groupBy("xps_value").agg(F.array_sort(F.collect_list(F.struct(place, "med", "mad"))).alias("m"))
    arrays = arrays.select("xps_value", F.col("m.med").alias("med"), F.col("m.mad").alias("mad"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return frames.withColumn("salt", F.pmod(F.xxhash64("frame_id"), F.lit(salts)).cast("int")).join(arrays, ["xps_value", "salt"], "left").drop("salt")


def cleaned_pixels(frames: DataFrame, background: DataFrame, masks: DataFrame, s: Settings, salts: int = 16, sampled: DataFrame | None = None) -> DataFrame:
    """Pixels after subtraction, X-ray removal, drift removal and mask; statistics from ``sampled`` frames if given.

    Statistics are joined to frames, not to pixels: what follows inside a frame needs no
    further shuffle.
    """
    known = to_pixels(with_statistics(frames, _sample(frames, sampled, s), background, s, salts), beside=("med", "mad"))
    return apply_masks(reject_hits(subtract(known, background), s.sigma, s.ratio), masks)


def process_pixels(frames: DataFrame, background: DataFrame, masks: DataFrame, s: Settings, sampled: DataFrame | None = None) -> DataFrame:
    """The columns RESULT of each frame by the pixel path; a frame that has an error, no pixels or another shape keeps that error.

    Statistics are of a sample of the frames, or of those in ``sampled``.
    """
    all_ = checked(frames, s.height, s.width)
    good = all_.where("error IS NULL")
    cleaned = to_frames(cleaned_pixels(good, background, masks, s, sampled=sampled), s.height, s.width)
    last = centroid.centroid_trace(cleaned, s.guess, s.ring[0], s.ring[1], s.max_iterations, s.tolerance).withColumn("last", F.element_at("trace", -1))
    centred = last.select("frame_id", "xps_value", "width", "pixels", F.col("last.x").alias("center_x"), F.col("last.y").alias("center_y"), F.col("last.total").alias("total_count"))
    found = radial.centred_profiles(to_pixels(centred, deal=False, carry=("center_x", "center_y", "total_count")), s.height, s.width, s.radius, s.bins)
    return all_.select("frame_id", "filename", "xps_value", "error").join(found, "frame_id", "left").select(*StructType.fromDDL(RESULT).names)


class Kernel:
    """The steps on one frame as an array; constants are of the size of one frame."""

    def __init__(self, s: Settings, background: np.ndarray, keep: np.ndarray, drift: np.ndarray):
        self.s, self.background, self.keep, self.drift = s, background, keep == 1, drift == 0
        self.mx, self.my = mask_centre(s.height, s.width)
        y, x = np.mgrid[: s.height, : s.width]
        d = np.sqrt((x - self.mx) ** 2.0 + (y - self.my) ** 2.0)
        self.ring_y, self.ring_x = np.nonzero((d >= s.ring[0]) & (d <= s.ring[1]))
        edges = np.arange(s.bins + 1) * (s.radius / s.bins)
        place = np.searchsorted(edges, d, side="right") - 1
        self.disc_y, self.disc_x = np.nonzero((d < s.radius) & (place < s.bins))
        self.place = place[self.disc_y, self.disc_x]

    def clean(self, frame: np.ndarray, med: np.ndarray, mad: np.ndarray) -> np.ndarray:
        v = frame - self.background
        with np.errstate(invalid="ignore"):
            hit = v > med + self.s.sigma * mad
            near = hit.copy()
            near[1:] |= hit[:-1]
            near[:-1] |= hit[1:]
            near[:, 1:] |= hit[:, :-1]
            near[:, :-1] |= hit[:, 1:]
            v[near & (v > med + self.s.sigma * self.s.ratio * mad)] = np.nan
        sample = v[self.drift]
        sample = sample[~np.isnan(sample)]
        return np.where(self.keep, v - (sample.mean() if len(sample) else np.nan), np.nan)

    def _under(self, v: np.ndarray, y: np.ndarray, x: np.ndarray, cx: float, cy: float):
        """Values of the pixels that lie under mask pixels (y, x) when (cx, cy) is moved to the mask centre, where known."""
        c, r = x + int(np.rint(cx - self.mx)), y + int(np.rint(cy - self.my))
        inside = (c >= 0) & (c < self.s.width) & (r >= 0) & (r < self.s.height)
        values = np.full(len(c), np.nan)
        values[inside] = v[r[inside], c[inside]]
        known = ~np.isnan(values)
        return values[known], c[known], r[known], known

    def centroid(self, v: np.ndarray, cx: float, cy: float) -> tuple[float, float, float]:
        w, c, r, _ = self._under(v, self.ring_y, self.ring_x, cx, cy)
        total = float(w.sum())
        if not len(w):
            return cx, cy, 0.0
        if total <= 0:
            return self.mx + float(np.rint(cx - self.mx)), self.my + float(np.rint(cy - self.my)), total
        return float((w * c).sum()) / total, float((w * r).sum()) / total, total

    def centre(self, v: np.ndarray) -> tuple[float, float, float]:
        cx, cy = map(float, self.s.guess)
        for _ in range(self.s.max_iterations):
            nx, ny, _ = self.centroid(v, cx, cy)
            far = np.hypot(nx - cx, ny - cy)
            cx, cy = nx, ny
            if far < self.s.tolerance:
                break
        return self.centroid(v, cx, cy)

    def profile(self, v: np.ndarray, cx: float, cy: float) -> list[float | None]:
        w, _, _, known = self._under(v, self.disc_y, self.disc_x, cx, cy)
        place = self.place[known]
        n, total = (np.bincount(place, weights=x, minlength=self.s.bins) for x in (None, w))
        return [float(t / k) if k else None for t, k in zip(total, n)]


def _constants(spark: SparkSession, background: DataFrame, masks: DataFrame, s: Settings):
    """Background and both masks as arrays of one frame, for all tasks."""

    def image(rows: DataFrame, column: str) -> np.ndarray:
        out = np.full((s.height, s.width), np.nan)
        pdf = rows.select("r", "c", F.col(column).cast("double").alias("x")).toPandas()
        out[pdf["r"], pdf["c"]] = pdf["x"]
        return out

    return spark.sparkContext.broadcast((image(background, "bg"), image(masks, "keep"), image(masks, "bkg")))


def process_blocks(frames: DataFrame, background: DataFrame, masks: DataFrame, s: Settings, sampled: DataFrame | None = None, side: int = SIDE, salts: int = 16) -> DataFrame:
    """The columns RESULT of each frame by the block path; a frame that has an error, no pixels or another shape keeps that error.

    Subtraction, rejection of hits and the sums of the drift run on blocks of ``side`` pixels
    a side, which exchange the borders of their hits; blocks then meet once, by frame, for
    centre and profile. Statistics are joined by group and block, each split into ``salts`` parts.
    """
    at = Layout(s.height, s.width, side)
    all_ = checked(frames, s.height, s.width)
    good = all_.where("error IS NULL")
    constants = _constants(frames.sparkSession, background, masks, s)
    fixed = table_blocks(background.join(masks, ["r", "c"]), ("bg", "bkg"), at)
    stats = table_blocks(statistics(_sample(good, sampled, s), background, s), ("med", "mad"), at, ("xps_value",))
    stats = stats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = to_blocks(good, at).withColumn("salt", F.pmod(F.xxhash64("frame_id"), F.lit(salts)).cast("int"))
    known = dealt.join(stats, ["xps_value", "br", "bc", "salt"], "left").join(F.broadcast(fixed), ["br", "bc"])
    cleaned = from_blocks(rejected_blocks(marked_blocks(known, at, s.sigma, s.ratio), fixed, at), at, ("drift_sum", "drift_n"))

    def run(batches):
        kernel = Kernel(s, *constants.value)
        for pdf in batches:
            rows = []
            for f in pdf.itertuples(index=False):
                v = np.asarray(f.pixels, dtype=float).reshape(s.height, s.width)
                v = np.where(kernel.keep, v - (f.drift_sum / f.drift_n if f.drift_n else np.nan), np.nan)
                x, y, total = kernel.centre(v)
                rows.append((f.frame_id, x, y, total, kernel.profile(v, x, y)))
            yield pd.DataFrame(rows, columns=["frame_id", "center_x", "center_y", "total_count", "radial_profile"])

    found = cleaned.select("frame_id", "pixels", "drift_sum", "drift_n").mapInPandas(run, "frame_id long, center_x double, center_y double, total_count double, radial_profile array<double>")
    return all_.select("frame_id", "filename", "xps_value", "error").join(found, "frame_id", "left").select(*StructType.fromDDL(RESULT).names)


def process_frames(frames: DataFrame, background: DataFrame, masks: DataFrame, s: Settings, sampled: DataFrame | None = None, salts: int = 16) -> DataFrame:
    """The columns RESULT of each frame by the frame path: one row a frame, a frame that fails keeps its error.

    Statistics are of a sample of the frames, or of those in ``sampled``.
    Background and masks are one frame in size and go to all tasks. The medians of a group
    are one row beside each of its frames (see `with_statistics`). Kernels work on one frame
    after the other; a task holds an Arrow batch of frames, which
    ``spark.sql.execution.arrow.maxBytesPerBatch`` bounds, and pandas rows of a few MB of it.
    """
    constants = _constants(frames.sparkSession, background, masks, s)
    all_ = checked(frames, s.height, s.width)
    known = with_statistics(all_, _sample(all_.where("error IS NULL"), sampled, s), background, s, salts)
    made = to_arrow_schema(StructType.fromDDL(RESULT))

    def run(batches):
        kernel = Kernel(s, *constants.value)
        nothing = np.full(s.height * s.width, np.nan)
        for pdf in (part.to_pandas() for batch in batches for part in pieces(batch)):
            rows = []
            for f in pdf.itertuples(index=False):
                out = [f.frame_id, f.filename, f.xps_value, None, None, None, None, f.error]
                try:
                    if f.error is None:
                        v, med, mad = (np.asarray(nothing if a is None else a, dtype=float).reshape(s.height, s.width) for a in (f.pixels, f.med, f.mad))
                        v = kernel.clean(v, med, mad)
                        x, y, total = kernel.centre(v)
                        out[3:7] = x, y, total, kernel.profile(v, x, y)
                except Exception as e:  # one bad frame must not stop the others
                    out[7] = f"{type(e).__name__}: {e}"
                rows.append(out)
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=made.names), made, preserve_index=False)

    return known.select("frame_id", "filename", "xps_value", F.when(F.col("error").isNull(), F.col("pixels")).alias("pixels"), "error", "med", "mad").mapInArrow(run, RESULT)


def split_failures(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results without error, failed rows (filename, error))."""
    return results.where("error IS NULL").drop("error"), results.where("error IS NOT NULL").select("filename", "error", "xps_value")


def screening_image(frames: DataFrame, background: DataFrame, s: Settings, k: int = 0, size: int = 50, skip_missing: bool = False) -> DataFrame:
    """(xps_value, r, c, v): mean of ``size`` evenly spaced frames of the k-th largest group, for drawing masks on."""
    sizes = frames.groupBy("xps_value").agg(F.count("*").alias("n_files"))
    chosen = frames.join(grouping.nth_group(sizes, k).select("xps_value"), "xps_value", "left_semi")
    picked = grouping.evenly_spaced(chosen.select("frame_id", "xps_value", "filename"), size, order="filename")
    some = frames.join(picked.select("frame_id"), "frame_id", "left_semi")
    stats = statistics(bg.sample_frames(some, s.sample, s.seed), background, s)
    return bg.mean_image(remove_background(to_pixels(some), background, stats, s.sigma, s.ratio), skip_missing)


def run_directory(spark: SparkSession, path: str, out: str, background: DataFrame, masks: DataFrame, s: Settings, process: Callable[..., DataFrame] = process_frames) -> None:
    """Read a folder of TIFF files, process every group in one job, and write results and failures.

    ``process`` is the form of the chain: `process_frames`, or `process_pixels`.

    The output folder must not exist: a run never mixes with another. Files that can't be
    read and frames that can't be processed are in the failures; the others go on. ``out/all``
    has a row for each file, and results and failures come from it. The sample for the
    statistics is chosen by the files' names, so only its files are decoded for them; one that
    can't be read leaves the sample smaller.
    """
    frames = read_frames(spark, path).where("xps_value IS NOT NULL")
    chosen = bg.chosen_frames(list_files(spark, path).where("xps_value IS NOT NULL"), s.sample, s.seed)
    sampled = read_frames(spark, path, only=chosen)
    process(frames, background, masks, s, sampled=sampled).write.mode("errorifexists").parquet(f"{out}/all")
    done, failed = split_failures(spark.read.schema(RESULT).parquet(f"{out}/all"))
    save_results(done.drop("frame_id"), f"{out}/results", s.bins, mode="errorifexists")
    save_failures(failed, f"{out}/failed")
