"""Radix selection against sorted values, and the order of bits."""

import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ringlake.operators import selection
from ringlake.operators.background import mean_background
from ringlake.operators.selection import ordered_bits, radix_median

EDGES = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 0.1, 1 + 2**-52, 2 - 2**-52, 2.0**52, 3.0]


def bits(v):
    b = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
    return -b if v < 0 else b


def test_bits_are_those_of_the_double(spark):
    rng = np.random.default_rng(1)
    values = [*EDGES, *rng.normal(size=2000).tolist(), *np.exp(rng.uniform(-740, 709, 2000)).tolist()]
    found = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", ordered_bits(F.col("v")).alias("o")).collect()
    assert all(r.o == bits(values[r.i]) for r in found)
    odd = spark.createDataFrame([(None,), (math.nan,)], "v double").select(ordered_bits(F.col("v")).alias("o")).collect()
    assert [r.o for r in odd] == [None, None]


def medians(spark, groups, few, monkeypatch):
    monkeypatch.setattr(selection, "FEW", few)
    rows = [(k, v) for k, g in groups.items() for v in g]
    found = radix_median(spark.createDataFrame(rows, "r int, v double").repartition(3), ["r"]).collect()
    assert len(found) == len(groups)
    return {r.r: r["median"] for r in found}


@pytest.mark.parametrize("few", [0, 2, 64])
def test_medians_of_all_kinds_of_groups(spark, few, monkeypatch):
    """Even and odd numbers, ties, middles in different buckets, missing values; with all passes, or some and a sort."""
    rng = np.random.default_rng(few)
    groups = {0: [3.0], 1: [1.0, 2.0], 2: [-1.0, 1e300], 3: [5.0] * 9, 4: [-0.5, 0.5, -0.25, 0.25], 5: [1.0, None, 2.0], 6: [None], 7: [1.0, 1 + 2**-52], 8: [-3.0, -2.0, 0.0, 0.0]}
    groups |= {10 + i: np.round(rng.normal(size=n) * 4, i % 3).tolist() for i, n in enumerate((100, 101, 250, 333))}
    found = medians(spark, groups, few, monkeypatch)
    for k, g in groups.items():
        assert found[k] == (None if None in g else np.median(g)), k


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e300, max_value=1e300), min_size=1, max_size=9), min_size=1, max_size=20))
def test_medians_of_any_doubles(spark, lists):
    rows = [(k, v) for k, g in enumerate(lists) for v in g]
    found = {r.r: r["median"] for r in radix_median(spark.createDataFrame(rows, "r int, v double"), ["r"]).collect()}
    assert all(found[k] == np.median(g) for k, g in enumerate(lists))


def test_no_values_give_no_medians(spark):
    assert radix_median(spark.createDataFrame([], "r int, v double"), ["r"]).collect() == []


def test_the_median_background_holds_no_values(spark):
    """Counts and one list of FEW at most: no median aggregate, which would hold all values of a pixel."""
    rows = spark.createDataFrame([(i, 0.0, p // 2, p % 2, float(i * p)) for i in range(5) for p in range(4)], "frame_id int, xps_value double, r int, c int, v double")
    found = mean_background(rows, "median")
    assert "median(" not in found._jdf.queryExecution().toString().lower()
    assert {(r.r, r.c): r.bg for r in found.collect()} == {(p // 2, p % 2): 2.0 * p for p in range(4)}
