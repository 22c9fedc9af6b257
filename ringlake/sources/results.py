"""Sinks and sources of results, failures and run configuration."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ringlake.functions.naming import PLAIN_BIN, group_name
from ringlake.operators.frames import strict
from ringlake.operators.radial import wide
from ringlake.sources.scratch import checkpoint


@dataclass
class RunConfig:
    """What a run was made with. Lists: (large, gap), (sigma, ratio), (inner, outer, x, y) and (radius, bins)."""

    result_directory: str = ""
    background_directory: str = ""
    data_mask_directory: str = ""
    xps_grouping_param: list[float] = field(default_factory=lambda: [350, 0.0025])
    xray_removal_param: list[float] = field(default_factory=lambda: [29.6, 0.7])
    center_fitting_param: list[float] = field(default_factory=lambda: [40, 200, 512, 512])
    azimuthal_avg_param: list[float] = field(default_factory=lambda: [512, 512])

    @staticmethod
    def of(values: dict) -> RunConfig:
        return RunConfig(**{k: values[k] for k in RunConfig.__dataclass_fields__ if k in values})


CONFIG = "result_directory string, background_directory string, data_mask_directory string, xps_grouping_param array<double>, xray_removal_param array<double>, center_fitting_param array<double>, azimuthal_avg_param array<double>"


def save_config(spark: SparkSession, config: RunConfig, path: str) -> None:
    """One row of JSON, typed on reading: lists stay lists and nothing is evaluated."""
    spark.createDataFrame([(json.dumps(asdict(config)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_config(spark: SparkSession, path: str) -> RunConfig:
    row = spark.read.schema(CONFIG).json(path).first()
    if row is None:
        raise ValueError(f"no configuration in {path}")
    return RunConfig.of(row.asDict())


def save_configs(rows: DataFrame, path: str) -> None:
    """A line of JSON for each row of configurations; columns that they don't have get their defaults."""
    given = asdict(RunConfig())
    types = StructType.fromDDL(CONFIG)
    full = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(given[f.name]).cast(f.dataType) for f in types]
    rows.select(*[c.alias(f.name) for c, f in zip(full, types)]).write.mode("overwrite").json(path)


def load_configs(spark: SparkSession, path: str) -> DataFrame:
    """The configurations of a folder, typed: a row each."""
    return spark.read.schema(CONFIG).json(path)


def parse_configs(rows: DataFrame, column: str) -> DataFrame:
    """Configurations held as JSON text, as one struct column `config`."""
    return rows.withColumn("config", F.from_json(column, CONFIG))


def save_results(results: DataFrame, path: str, bins: int, mode: str = "append") -> None:
    """Wide rows as Parquet, a folder for each scan position; appending adds files and rewrites none.

    The rows of a position are first dealt to tasks by (position, frame hash), so that a
    position of any size is written by many tasks, each with one open file a position.
    """
    rows = wide(results, bins).withColumn("xps_key", group_name(F.col("xps_value")))
    rows.repartition("xps_key", F.pmod(F.xxhash64("filename"), F.lit(16))).write.mode(mode).partitionBy("xps_key").parquet(path)


def load_results(spark: SparkSession, path: str, bins: int) -> DataFrame:
    """Results with radial_profile as an array again."""
    rows = spark.read.parquet(path)
    return rows.select("filename", "center_x", "center_y", "total_count", "xps_value", F.array(*[F.col(f"radial_bin_{i:03d}") for i in range(bins)]).alias("radial_profile"))


def save_results_csv(results: DataFrame, path: str, bins: int) -> None:
    wide(results, bins, PLAIN_BIN).write.mode("append").option("header", True).csv(path)


def save_failures(failed: DataFrame, path: str, mode: str = "append") -> None:
    """(filename, error) as CSV; nothing is written if there is none. The rows are kept first, so that what made them runs once."""
    rows = checkpoint(failed.select("filename", "error"))
    if not rows.isEmpty():
        rows.write.mode(mode).option("header", True).csv(path)


def report(results: DataFrame, bins: int) -> dict[str, DataFrame]:
    """The sections of a text report: a header, centres and counts to three places, the mean profile to six."""
    positions = results.select("xps_value", F.posexplode("radial_profile").alias("bin", "mean")).where(F.col("bin") < bins)
    return {
        "header": results.groupBy("xps_value").agg(F.count("*").alias("n_frames")),
        "centres": results.select("filename", F.format_string("%.3f", "center_x").alias("center_x"), F.format_string("%.3f", "center_y").alias("center_y")),
        "counts": results.select("filename", F.format_string("%.3f", "total_count").alias("total_count")),
        "profile": positions.groupBy("xps_value", "bin").agg(F.format_string("%.6f", strict(F.avg("mean"), "mean")).alias("mean"), F.format_string("%.6f", strict(F.stddev_pop("mean"), "mean")).alias("std")),
    }


def save_report(results: DataFrame, path: str, bins: int, sections: Sequence[str] = ("header", "centres", "counts", "profile")) -> None:
    for name, rows in report(results, bins).items():
        if name in sections:
            rows.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
