"""Columns over frame file names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scan token of a file name, what follows it, and the formats of group and bin names.
SCAN_TOKEN = r"_xps([0-9]+\.[0-9]+)_"
SCAN_SUFFIX = r"_xps[0-9.]+_(.*)"
GROUP_NAME = "xps_%.5f"
WIDE_BIN = "radial_bin_{:03d}"
PLAIN_BIN = "radial_bin_{}"


def scan_value(name: Column) -> Column:
    """The scan position in a file name as a double; null where the token is missing."""
    return F.nullif(F.regexp_extract(name, SCAN_TOKEN, 1), F.lit("")).try_cast("double")


def scan_key(name: Column) -> Column:
    """The scan position as a decimal: a grouping key without float equality."""
    return F.nullif(F.regexp_extract(name, SCAN_TOKEN, 1), F.lit("")).try_cast("decimal(18,6)")


def suffix(name: Column) -> Column:
    """What follows the scan token; null where it is missing."""
    return F.nullif(F.regexp_extract(name, SCAN_SUFFIX, 1), F.lit(""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def group_name(value: Column) -> Column:
    return F.format_string(GROUP_NAME, value)
