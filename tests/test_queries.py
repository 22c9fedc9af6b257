"""Every query of the catalog against its SQL, and what the entry module offers."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import oracle
from ringlake.plans.catalog import ORACLE, QUERIES, chain_inputs
from ringlake.plans.pipeline import process_frames, process_pixels

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return oracle.tables(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_are_those_of_the_sql(spark, duck, name):
    assert oracle.differences(QUERIES[name](spark, SF).toArrow(), duck.sql(ORACLE[name]).to_arrow_table()) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_the_entry_module_needs_no_session():
    """Queries are listed before a session exists, and every SQL belongs to a query."""
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], timeout=120, check=False).returncode == 0


def test_the_flagship_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["frame_id", "bin", "bin_center", "mean"]


def test_pixel_path_and_frame_path_agree(spark):
    """On all good frames, and on frames without pixels, with none, of another shape and with an error of their own."""
    f, zero, masks, s = chain_inputs(spark, SF)
    f = f.withColumn("error", F.when(F.col("frame_id") == 5, "unreadable"))
    odd = {1: F.lit(None).cast("array<double>"), 2: F.array().cast("array<double>"), 3: F.slice("pixels", 1, 9)}
    bent = F.col("pixels")
    for i, p in odd.items():
        bent = F.when(F.col("frame_id") == i, p).otherwise(bent)
    f = f.withColumn("pixels", bent).withColumn("height", F.when(F.col("frame_id") == 4, 3).otherwise(F.col("height")))
    a, b = ({r.frame_id: r for r in p(f, zero, masks, s).collect()} for p in (process_pixels, process_frames))
    assert set(a) == set(b) and len(a) == 500
    assert {i for i, r in a.items() if r.error} == {1, 2, 3, 4, 5} and "without pixels" in a[1].error and a[5].error == "unreadable"
    for k, x in a.items():
        y = b[k]
        assert x.error == y.error and x.filename == y.filename
        for c in ("center_x", "center_y", "total_count"):
            assert x[c] == (y[c] if x.error else pytest.approx(y[c], rel=1e-9, abs=1e-9))
        assert len(x.radial_profile or []) == len(y.radial_profile or [])
        for p, q in zip(x.radial_profile or [], y.radial_profile or []):
            assert (p is None and q is None) or p == pytest.approx(q, rel=1e-9, abs=1e-9)
