"""Runs of whole folders: what a configuration names is found and read, groups are merged or not, and a run that stopped goes on."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ringlake.functions.naming import group_name
from ringlake.operators import background as bg
from ringlake.operators import grouping, lookups
from ringlake.operators.frames import checked
from ringlake.plans.pipeline import RESULT, Settings, process_frames, split_failures
from ringlake.sources.formats import frame_source
from ringlake.sources.results import RunConfig, save_failures, save_results
from ringlake.sources.scratch import checkpoint
from ringlake.sources.tiff import list_files, read_frames

# The word for files beside the results, and their names.
DEFAULT = "default"
BACKGROUND, DATA_MASK, DRIFT_MASK = "background.tiff", "data_mask.tiff", "background_mask.tiff"


def listed_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the TIFF files right in a folder: .tiff before .tif, in order of names; none if it isn't there. Contents and folders in it stay unread."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath().toString() for f in system.listStatus(path) if f.isFile()] if system.exists(path) else []
    return sorted((f for f in found if f.lower().endswith((".tif", ".tiff"))), key=lambda f: (f.lower().endswith(".tif"), f))


def constant_pixels(spark: SparkSession, path: str, height: int, width: int, name: str) -> DataFrame:
    """(r, c, ``name``) of one TIFF file of the detector's shape; a file that can't be read or has another shape is an error."""
    frame = checked(read_frames(spark, path), height, width)
    whole = F.when(F.col("error").isNull(), F.col("pixels")).otherwise(F.raise_error(F.concat(F.lit(f"{path}: "), F.col("error"))).cast("array<double>"))
    rows = frame.select(F.posexplode(whole).alias("p", "v"))
    return rows.select(F.floor(F.col("p") / width).cast("int").alias("r"), (F.col("p") % width).cast("int").alias("c"), F.nanvl("v", F.lit(None).cast("double")).alias(name))


def resolve_background(spark: SparkSession, config: RunConfig, height: int, width: int) -> DataFrame:
    """(r, c, bg): `background.tiff` beside the results where the folder is `default`, else the first TIFF file of the folder."""
    folder = config.result_directory if config.background_directory == DEFAULT else config.background_directory
    files = listed_files(spark, folder)
    if config.background_directory == DEFAULT:
        files = [f for f in files if f.rsplit("/", 1)[-1] == BACKGROUND]
    if not files:
        raise FileNotFoundError(f"no background in {folder}")
    return constant_pixels(spark, files[0], height, width, "bg")


def resolve_masks(spark: SparkSession, config: RunConfig, height: int, width: int) -> DataFrame:
    """(r, c, keep, bkg) of the mask files in the folder (beside the results for `default`).

    Without a mask of the signal every pixel is kept and the drift sample is the four
    corners; without one of the drift sample alone the corners are taken too.
    """
    folder = config.result_directory if config.data_mask_directory == DEFAULT else config.data_mask_directory
    files = {f.rsplit("/", 1)[-1]: f for f in listed_files(spark, folder)}
    corners = lookups.corner_masks(spark, height, width, min(lookups.CORNER, height // 2, width // 2))
    if DATA_MASK not in files:
        return corners
    keep = constant_pixels(spark, files[DATA_MASK], height, width, "keep")
    drift = constant_pixels(spark, files[DRIFT_MASK], height, width, "bkg") if DRIFT_MASK in files else corners.select("r", "c", "bkg")
    return keep.join(F.broadcast(drift), ["r", "c"]).select("r", "c", F.col("keep").cast("int").alias("keep"), F.col("bkg").cast("int").alias("bkg"))


def settings_of(config: RunConfig, height: int, width: int) -> Settings:
    """Settings from a configuration's parameter lists."""
    inner, outer, x, y = config.center_fitting_param
    sigma, ratio = config.xray_removal_param
    radius, bins = config.azimuthal_avg_param
    return Settings(height, width, (x, y), ring=(inner, outer), radius=radius, bins=int(bins), sigma=sigma, ratio=ratio)


def kept_listing(spark: SparkSession, path: str) -> DataFrame:
    """The rows of `list_files`, listed once and kept.

    No file is opened, so that each counts as a KiB where files are packed into tasks; at
    Spark's own 4 MiB a task would have some thirty files, in this scan and in each that follows.
    """
    cost = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(cost)
    spark.conf.set(cost, "1k")
    try:
        return checkpoint(list_files(spark, path))
    finally:
        spark.conf.set(cost, before)


MANIFEST = "key string, n_files long, error string"


def planned_groups(files: DataFrame, merge: tuple[int, float] | None = None, first: int | None = None) -> DataFrame:
    """(key, xps_value, n_files, own) of the groups of a listing: own positions each, or merged ones with (large, gap); all, or the ``first`` in order.

    ``key`` is the position to five places, the name of the group's folder; ``own`` are the
    positions in its files' names. A row a group.
    """
    sizes = files.where("xps_value IS NOT NULL").groupBy("xps_value").agg(F.count("*").alias("n_files"))
    if merge is not None:
        sizes = checkpoint(sizes)  # a row a position, which merging reads several times
        sizes = grouping.merge_groups(sizes, int(merge[0]), merge[1]).select(F.col("xps_value").alias("own"), F.col("merged_value").alias("xps_value"), "n_files")
    else:
        sizes = sizes.withColumn("own", F.col("xps_value"))
    keyed = sizes.withColumn("key", group_name(F.col("xps_value")))
    groups = keyed.groupBy("key").agg(F.min("xps_value").alias("xps_value"), F.sum("n_files").alias("n_files"), F.array_sort(F.collect_list("own")).alias("own"))
    return groups if first is None else grouping.first_rows(groups, first, "xps_value")


def finished_groups(spark: SparkSession, out: str) -> DataFrame:
    """(key, n_files) of the groups whose results are complete."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{out}/manifest").where("error IS NULL").select("key", "n_files").distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "key string, n_files long")


def run_groups(
    spark: SparkSession, path: str, out: str, background: DataFrame, masks: DataFrame, s: Settings,
    process: Callable[..., DataFrame] = process_frames, merge: tuple[int, float] | None = None, first: int | None = None, at_once: int = 16,
) -> DataFrame:
    """Process the groups of a folder of TIFF files that aren't finished yet; returns the manifest's rows (key, n_files, error) of this call.

    ``at_once`` groups make one job, whose results replace what these groups had in
    ``out/all``; only then is each noted in ``out/manifest``. So a run that stops anywhere is
    gone on with by the same call: groups in the manifest are left alone, unless they have
    another number of files by now. If a job fails its groups are tried one by one, and one
    that fails then is noted with its error; the others go on, and the next call tries it
    again. Files of other groups are never opened. At the end ``out/results`` and
    ``out/failed`` are made again from all finished groups.
    """
    files = kept_listing(spark, path).where("xps_value IS NOT NULL")
    groups = planned_groups(files, merge, first)
    open_ = groups.join(finished_groups(spark, out), ["key", "n_files"], "left_anti").orderBy("xps_value").collect()  # a row a group
    noted: list[tuple] = []

    def note(some: Sequence[Row], error: str | None) -> None:
        rows = [(g.key, g.n_files, error) for g in some]
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{out}/manifest")
        noted.extend(rows)

    def work(some: Sequence[Row]) -> None:
        own = [v for g in some for v in g.own]
        values = F.create_map(*[F.lit(x) for g in some for v in g.own for x in (v, g.xps_value)])
        frames = frame_source(spark, path).where(F.col("xps_value").isin(own)).withColumns({"frame_id": F.xxhash64("path"), "xps_value": values[F.col("xps_value")]})
        listed = files.where(F.col("xps_value").isin(own)).withColumn("xps_value", values[F.col("xps_value")])
        chosen = bg.chosen_frames(listed, s.sample, s.seed).select("filename")
        done = process(frames, background, masks, s, sampled=frames.join(chosen, "filename", "left_semi"))
        keyed = done.withColumn("xps_key", group_name(F.col("xps_value")))
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("xps_key").parquet(f"{out}/all")
        note(some, None)

    for i in range(0, len(open_), at_once):
        some = open_[i : i + at_once]
        try:
            work(some)
        except Exception:
            for g in some:
                try:
                    work([g])
                except Exception as e:  # one bad group must not stop the others
                    note([g], f"{type(e).__name__}: {e}"[:2000])
    kept = finished_groups(spark, out)
    if not kept.isEmpty():
        rows = spark.read.schema(f"{RESULT}, xps_key string").parquet(f"{out}/all")
        done, failed = split_failures(rows.join(kept.select(F.col("key").alias("xps_key")), "xps_key", "left_semi").drop("xps_key"))
        save_results(done.drop("frame_id"), f"{out}/results", s.bins, mode="overwrite")
        save_failures(failed, f"{out}/failed", mode="overwrite")
    return spark.createDataFrame(noted, MANIFEST)


def run_configured(spark: SparkSession, config: RunConfig, frames: str, height: int, width: int, name: str = "run", merged: bool = False, first: int | None = None, process: Callable[..., DataFrame] = process_frames) -> str:
    """Everything of one configuration: find background and masks, process the folder ``frames``, return the folder of the results.

    Groups are those of the files' positions; with ``merged`` they are merged first, by the
    configuration's xps_grouping_param (large, gap), which counts for nothing otherwise.
    ``first`` leaves all but the first groups out. Called again, it goes on with what isn't finished.
    """
    out = f"{config.result_directory}/{name}"
    large, gap = config.xps_grouping_param
    run_groups(spark, frames, out, resolve_background(spark, config, height, width), resolve_masks(spark, config, height, width), settings_of(config, height, width), process, (int(large), gap) if merged else None, first)
    return out


def merged_frames(frames: DataFrame, large: int = grouping.LARGE, gap: float = grouping.GAP, first: int | None = None) -> DataFrame:
    """The frames of merged groups, with xps_value the merged one: all of them, or the ``first`` in order of position.

    Groups are counted and merged as rows of their own; frames only meet the table of groups.
    """
    sizes = frames.where("xps_value IS NOT NULL").groupBy("xps_value").agg(F.count("*").alias("n_files"))
    merged = grouping.merge_groups(sizes, large, gap).select(F.col("xps_value").alias("own_value"), "merged_value")
    if first is not None:
        merged = merged.join(grouping.first_rows(merged.select("merged_value").distinct(), first, "merged_value"), "merged_value", "left_semi")
    joined = frames.join(merged, F.col("xps_value") == F.col("own_value"))
    return joined.select(*[F.col("merged_value").alias("xps_value") if c == "xps_value" else F.col(c) for c in frames.columns])


def process_merged(frames: DataFrame, background: DataFrame, masks: DataFrame, s: Settings, large: int = grouping.LARGE, gap: float = grouping.GAP, first: int | None = 2) -> DataFrame:
    """Group, merge, take the first groups and process their frames."""
    return process_frames(merged_frames(frames, large, gap, first), background, masks, s)
