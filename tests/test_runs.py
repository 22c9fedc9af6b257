"""Runs of folders by groups: stopped and gone on with, with groups that fail, with files that come later, merged by configuration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringlake.operators import lookups
from ringlake.plans.pipeline import Settings, process_blocks, process_frames
from ringlake.plans.run import finished_groups, planned_groups, run_configured, run_groups
from ringlake.sources import tiff
from ringlake.sources.results import RunConfig, load_results

N = 12
S = Settings(N, N, (6.0, 6.0), ring=(1, 4), radius=6, bins=3, sigma=20, ratio=0.5, box=2)


class Stopped(BaseException):
    """What ends a run from outside."""


def write(folder, positions, per_group=3, start=0):
    rng = np.random.default_rng(start)
    for x in positions:
        for i in range(start, start + per_group):
            (folder / f"c_xps{x:.4f}_s{i}.tiff").write_bytes(tiff.encode(rng.random((N, N)) + 1, compress=False))


@pytest.fixture
def setting(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    write(data, (1.0, 1.001, 2.0, 3.0))
    return str(data), str(tmp_path / "out"), lookups.grid(spark, N, N).withColumn("bg", F.lit(0.5)), lookups.corner_masks(spark, N, N, 2)


def recording(calls, stop_at=None, fails=()):
    """The chain on frames, which notes the positions that it is called with, and may stop or fail."""

    def process(frames, *args, **options):
        calls.append(sorted({r.xps_value for r in frames.select("xps_value").distinct().collect()}))
        if len(calls) == stop_at:
            raise Stopped
        if any(x in fails for x in calls[-1]):
            raise ValueError("a bad group")
        return process_frames(frames, *args, **options)

    return process


def rows(spark, out):
    return sorted((r.filename, r.xps_value, round(r.center_x, 9), round(r.total_count, 9), tuple(None if x is None else round(x, 9) for x in r.radial_profile)) for r in load_results(spark, f"{out}/results", S.bins).collect())


def test_a_stopped_run_goes_on(spark, setting, tmp_path):
    data, out, level, masks = setting
    calls = []
    with pytest.raises(Stopped):
        run_groups(spark, data, out, level, masks, S, recording(calls, stop_at=2), at_once=1)
    assert [r.key for r in finished_groups(spark, out).collect()] == ["xps_1.00000"]
    noted = run_groups(spark, data, out, level, masks, S, recording(calls), at_once=2).collect()
    assert calls == [[1.0], [1.001], [1.001, 2.0], [3.0]] and len(noted) == 3
    assert run_groups(spark, data, out, level, masks, S, recording(calls)).collect() == [] and len(calls) == 4
    whole = str(tmp_path / "whole")
    run_groups(spark, data, whole, level, masks, S)
    assert rows(spark, out) == rows(spark, whole) and len(rows(spark, out)) == 12
    blocks = str(tmp_path / "blocks")
    run_groups(spark, data, blocks, level, masks, S, process_blocks)
    for a, b in zip(rows(spark, blocks), rows(spark, whole)):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-8)


def test_a_bad_group_stops_no_other(spark, setting):
    """Its error is noted, and the next call tries it again, alone."""
    data, out, level, masks = setting
    calls = []
    noted = run_groups(spark, data, out, level, masks, S, recording(calls, fails=(2.0,))).collect()
    assert {r.key: r.error for r in noted} == {"xps_1.00000": None, "xps_1.00100": None, "xps_2.00000": "ValueError: a bad group", "xps_3.00000": None}
    assert len(rows(spark, out)) == 9
    run_groups(spark, data, out, level, masks, S, recording(calls))
    assert calls[-1] == [2.0] and len(rows(spark, out)) == 12


def test_files_that_come_later_and_files_that_break(spark, setting, tmp_path):
    """A group with new files is made again as a whole; a broken file is a failure of its own."""
    data, out, level, masks = setting
    run_groups(spark, data, out, level, masks, S)
    write(tmp_path / "data", (2.0,), per_group=2, start=7)
    (tmp_path / "data" / "c_xps3.0000_s0.tiff").write_bytes(b"broken")
    calls = []
    run_groups(spark, data, out, level, masks, S, recording(calls))
    assert calls == [[2.0]] and len(rows(spark, out)) == 14
    (tmp_path / "data" / "c_xps3.0000_s9.tiff").write_bytes(b"broken")
    run_groups(spark, data, out, level, masks, S, recording(calls))
    failed = spark.read.option("header", True).csv(f"{out}/failed").collect()
    assert calls[-1] == [3.0] and sorted(r.filename for r in failed) == ["c_xps3.0000_s0.tiff", "c_xps3.0000_s9.tiff"] and len(rows(spark, out)) == 13


def test_nothing_to_run(spark, setting, tmp_path):
    _, out, level, masks = setting
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "x.tiff").write_bytes(tiff.encode(np.ones((N, N))))  # without a position
    assert run_groups(spark, str(empty), out, level, masks, S).collect() == []


def test_groups_are_merged_as_configured(spark, setting):
    data, out, _, _ = setting
    groups = planned_groups(tiff.list_files(spark, data), (2, 0.0025)).orderBy("xps_value").collect()
    assert [(g.n_files, g.own) for g in groups] == [(6, [1.0, 1.001]), (3, [2.0]), (3, [3.0])] and groups[0].key == "xps_1.00050"
    config = RunConfig(out, out, "default", xps_grouping_param=[2, 0.0025], center_fitting_param=[1, 4, 6, 6], azimuthal_avg_param=[6, 3])
    import os

    os.makedirs(out)
    with open(f"{out}/b.tiff", "wb") as f:
        f.write(tiff.encode(np.full((N, N), 0.5)))
    merged = run_configured(spark, config, data, N, N, "merged", merged=True, first=2)
    assert sorted({round(r[1], 6) for r in rows(spark, merged)}) == [1.0005, 2.0] and len(rows(spark, merged)) == 9
    alone = run_configured(spark, config, data, N, N, "alone")
    assert sorted({r[1] for r in rows(spark, alone)}) == [1.0, 1.001, 2.0, 3.0]
