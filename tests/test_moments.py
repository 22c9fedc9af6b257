"""States that merge: batches of any cut give what all rows at once give, also over a stream that is stopped and started."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringlake.operators.moments import merged, moments, profile_state, profile_statistics_of, run_state, run_summary_of
from ringlake.operators.radial import profile_statistics
from ringlake.operators.summary import run_summary
from ringlake.streaming.statistics import latest_state, merge_batches

PROFILES = "xps_value double, bin int, mean double, k int"
COLUMNS = (("xps_value", "bin"), ("mean",))


def profiles(spark, n=400):
    """A group with a missing value, one far from zero with small deviations, one of a single row, one without a position."""
    rng = np.random.default_rng(2)
    rows = [(120.0 + i % 3, int(rng.integers(0, 4)), float(rng.normal() + (1e8 if i % 3 == 2 else 0)), i) for i in range(n)]
    return spark.createDataFrame([*rows, (120.0, 1, None, n), (130.0, 0, 2.5, n + 1), (None, 0, 1.0, n + 2), (None, 0, 3.0, n + 3)], PROFILES)


def by_key(rows, keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in rows.collect()}


def same(a, b, keys):
    a, b = by_key(a, keys), by_key(b, keys)
    assert set(a) == set(b)
    for k in a:
        for c in a[k]:
            assert a[k][c] == (b[k][c] if b[k][c] is None else pytest.approx(b[k][c], rel=1e-7, abs=1e-12)), (k, c)  # means of 1e8 are known to 1e-8


@pytest.mark.parametrize("cuts", [1, 2, 7, 50])
def test_batches_of_any_cut_are_all_rows_at_once(spark, cuts):
    p = profiles(spark)
    states = moments(p.withColumn("cut", F.pmod(F.xxhash64("k"), F.lit(cuts))), ("cut", *COLUMNS[0]), COLUMNS[1]).drop("cut")
    same(profile_statistics_of(merged(states, *COLUMNS)), profile_statistics(p), COLUMNS[0])


def test_states_merge_in_any_order(spark):
    """One after the other, or pairs first."""
    p = profiles(spark)
    a, b, c = (profile_state(p.where(F.col("k") % 3 == i)) for i in range(3))
    left = merged(merged(a.unionByName(b), *COLUMNS).unionByName(c), *COLUMNS)
    same(left, merged(a.unionByName(merged(b.unionByName(c), *COLUMNS)), *COLUMNS), COLUMNS[0])


def test_run_summaries_merge(spark):
    rng = np.random.default_rng(4)
    rows = [(100.0 + i % 2, float(rng.normal()), float(rng.normal()), float(rng.random()), rng.normal(size=5).tolist(), i) for i in range(90)]
    rows.append((100.0, None, 1.0, None, [None, 7.0], 90))
    r = spark.createDataFrame(rows, "xps_value double, center_x double, center_y double, total_count double, radial_profile array<double>, k int")
    parts = [run_state(r.where(F.col("k") % 4 == i)) for i in range(4)]
    states = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    same(run_summary_of(merged(states, ("xps_value",), ("center_x", "center_y", "total_count", "hi", "lo"))), run_summary(r), ("xps_value",))


def test_no_rows_have_no_state(spark):
    assert profile_state(profiles(spark).limit(0)).collect() == []


def test_a_stream_is_stopped_and_started(spark, tmp_path):
    """Files come in two parts; a batch that is made again after its state was written counts once."""
    p, source, state, marks = profiles(spark), f"{tmp_path}/in", f"{tmp_path}/state", f"{tmp_path}/marks"
    assert latest_state(spark, state) is None
    for part in (0, 1):
        p.where(F.col("k") % 2 == part).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PROFILES).option("maxFilesPerTrigger", 1).parquet(source)
        merge_batches(stream, *COLUMNS, state, marks).awaitTermination(120)
        if part == 0:
            same(profile_statistics_of(latest_state(spark, state)), profile_statistics(p.where("k % 2 = 0")), COLUMNS[0])
    same(profile_statistics_of(latest_state(spark, state)), profile_statistics(p), COLUMNS[0])
    import os

    last = max(int(f) for f in os.listdir(f"{marks}/commits") if f.isdigit())
    for f in (f"{marks}/commits/{last}", f"{marks}/commits/.{last}.crc"):
        if os.path.exists(f):
            os.remove(f)  # as if it had stopped before its commit
    merge_batches(spark.readStream.schema(PROFILES).option("maxFilesPerTrigger", 1).parquet(source), *COLUMNS, state, marks).awaitTermination(120)
    same(profile_statistics_of(latest_state(spark, state)), profile_statistics(p), COLUMNS[0])
