"""Count, mean and squared deviations as a state that merges: statistics of rows that come in batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is kept of a column: its known values' number, mean and sum of squared deviations from it, least and greatest.
PARTS = ("known", "mean", "m2", "least", "most")


def moments(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, n, and PARTS of each column) of the rows of each key, in one aggregate."""

    def parts(c: str) -> list[Column]:
        known = F.count(c)
        return [a.alias(f"{c}_{p}") for a, p in zip((known, F.avg(c), F.var_pop(c) * known, F.min(c), F.max(c)), PARTS)]

    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[a for c in columns for a in parts(c)])


def merged(states: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One state a key of any number of them; the order of merging changes only the last digits.

    Squared deviations are moved from each state's own mean to the common one: sums of
    squares, whose difference would lose small deviations of large values, are never taken.
    """
    means = states.groupBy(*keys).agg(*[(F.sum(F.col(f"{c}_mean") * F.col(f"{c}_known")) / F.nullif(F.sum(f"{c}_known"), F.lit(0))).alias(f"__{c}") for c in columns])
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    both = states.alias("s").join(means.alias("m"), same).select("s.*", *[f"m.__{c}" for c in columns])

    def parts(c: str) -> list[Column]:
        apart = F.col(f"{c}_mean") - F.col(f"__{c}")
        return [a.alias(f"{c}_{p}") for a, p in zip((F.sum(f"{c}_known"), F.first(f"__{c}"), F.sum(F.col(f"{c}_m2") + F.col(f"{c}_known") * apart * apart), F.min(f"{c}_least"), F.max(f"{c}_most")), PARTS)]

    return both.groupBy(*keys).agg(F.sum("n").alias("n"), *[a for c in columns for a in parts(c)])


def mean_of(column: str, strict: bool = False) -> Column:
    """The mean; with ``strict`` null as soon as a value is missing."""
    return F.when((F.col(f"{column}_known") == F.col("n")) | F.lit(not strict), F.col(f"{column}_mean"))


def deviation_of(column: str, strict: bool = False) -> Column:
    """The population deviation; with ``strict`` null as soon as a value is missing."""
    return F.when((F.col(f"{column}_known") == F.col("n")) | F.lit(not strict), F.sqrt(F.col(f"{column}_m2") / F.nullif(F.col(f"{column}_known"), F.lit(0))))


PROFILE = ("xps_value", "bin"), ("mean",)
RUN = ("xps_value",), ("center_x", "center_y", "total_count", "hi", "lo")


def profile_state(profiles: DataFrame) -> DataFrame:
    """The state of profiles (xps_value, bin, mean)."""
    return moments(profiles, *PROFILE)


def profile_statistics_of(state: DataFrame) -> DataFrame:
    """(xps_value, bin, mean, std), as `profile_statistics` gives them of all rows at once."""
    return state.select("xps_value", "bin", mean_of("mean", True).alias("mean"), deviation_of("mean", True).alias("std"))


def run_state(results: DataFrame) -> DataFrame:
    """The state of results (xps_value, center_x, center_y, total_count, radial_profile)."""
    return moments(results.withColumns({"hi": F.array_max("radial_profile"), "lo": F.array_min("radial_profile")}), *RUN)


def run_summary_of(state: DataFrame) -> DataFrame:
    """The columns that `run_summary` gives of all rows at once."""
    centres = [f(c).alias(f"{n}_{c}") for c in RUN[1][:3] for n, f in (("mean", mean_of), ("std", deviation_of))]
    return state.select("xps_value", F.col("n").alias("n_frames"), *centres, F.col("hi_most").alias("profile_max"), F.col("lo_least").alias("profile_min"))
