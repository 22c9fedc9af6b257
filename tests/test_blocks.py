"""Blocked frames: the layout and its inverse, neighbours over borders, clusters over many blocks, and the chain on blocks."""

import time
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringlake.operators import blocks as bl
from ringlake.operators import lookups, morphology
from ringlake.operators.blocks import Layout
from ringlake.operators.frames import to_frames, to_pixels
from ringlake.operators.graph import components
from ringlake.plans.pipeline import Settings, process_blocks, process_frames, process_pixels

FRAMES = "frame_id long, xps_value double, height int, width int, pixels array<double>"
SIDES = [2, 3, 8, 64]


def frames_of(spark, images):
    """Frames of matrices; NaN is missing."""
    rows = [(i, 1.0 + i % 2, *m.shape, [None if np.isnan(x) else float(x) for x in m.ravel()]) for i, m in enumerate(images)]
    return spark.createDataFrame(rows, FRAMES)


def images_of(frames):
    return {r.frame_id: np.array([np.nan if x is None else x for x in r.pixels]).reshape(r.height, r.width) for r in frames.collect()}


def noise(n, height, width, missing=0.05, seed=1):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, height, width)).round(3)
    out[rng.random(out.shape) < missing] = np.nan
    return list(out)


@pytest.mark.parametrize("side", SIDES)
@pytest.mark.parametrize("shape", [(8, 8), (7, 10), (1, 5)])
def test_blocks_and_back(spark, side, shape):
    images = noise(3, *shape)
    at = Layout(*shape, side)
    cut = bl.to_blocks(frames_of(spark, images), at)
    assert cut.count() == 3 * at.down * at.across
    assert all(len(r.v) == np.prod(np.diff(np.array(at.span(r.br, r.bc)).reshape(2, 2))) for r in cut.collect())
    back = images_of(bl.from_blocks(cut, at))
    assert all(np.array_equal(back[i], m, equal_nan=True) for i, m in enumerate(images))


def test_missing_blocks_and_other_shapes_are_errors(spark):
    at = Layout(4, 4, 2)
    f = frames_of(spark, noise(2, 4, 4))
    with pytest.raises(Exception, match="blocks are missing"):
        bl.from_blocks(bl.to_blocks(f, at).where("br + bc < 2"), at).collect()
    with pytest.raises(Exception, match="not 5 x 4 pixels"):
        bl.to_blocks(f, Layout(5, 4, 2)).collect()
    with pytest.raises(ValueError):
        Layout(4, 4, 0)
    assert bl.from_blocks(bl.to_blocks(f.limit(0), at), at).collect() == []


@pytest.mark.parametrize("side", SIDES)
@pytest.mark.parametrize("margin", [1, 2, 5])
def test_each_block_gets_all_pixels_around_it(spark, side, margin):
    """Margins wider than a block reach over several; the last ones are thinner."""
    images = noise(1, 7, 10)
    at = Layout(7, 10, side)
    rows = bl.exchange(bl.to_blocks(frames_of(spark, images), at), "v", margin, at).collect()
    for r in rows:
        top, end, left, right = at.around(r.br, r.bc, margin)
        y, y_end, x, x_end = at.span(r.br, r.bc)
        seen = np.zeros((end - top, right - left), dtype=int)
        seen[y - top : y_end - top, x - left : x_end - left] += 1
        for s in r.halo or []:
            place = np.s_[s.r : s.r + s.h, s.c : s.c + s.w]
            assert np.array_equal(np.array([np.nan if v is None else v for v in s.v]).reshape(s.h, s.w), images[0][place], equal_nan=True)
            seen[s.r - top : s.r - top + s.h, s.c - left : s.c - left + s.w] += 1
        assert (seen == 1).all()


@pytest.mark.parametrize("side", [2, 3, 8])
def test_dilation_is_that_of_pixels(spark, side):
    f = frames_of(spark, noise(4, 9, 7))
    hit = F.transform("v", lambda v: (v > 1).cast("double"))
    at = Layout(9, 7, side)
    near = images_of(bl.from_blocks(bl.dilated_blocks(bl.to_blocks(f, at).withColumn("hit", hit), at).select("frame_id", "xps_value", "br", "bc", F.col("near").alias("v")), at))
    flagged = to_pixels(f).withColumn("hit", F.coalesce(F.col("v") > 1, F.lit(False))).withColumn("near", morphology.dilated("hit"))
    for r in flagged.collect():
        assert near[r.frame_id][r.r, r.c] == r.near


@pytest.mark.parametrize("side", [2, 3, 8])
@pytest.mark.parametrize("name,option", [("gaussian", 0.75), ("gaussian", 2.0), ("box", 3), ("box", 5)])
def test_blurs_are_those_of_whole_frames(spark, side, name, option):
    """Also with kernels wider than blocks and than the frame."""
    f = frames_of(spark, noise(2, 9, 7, missing=0.02))
    at = Layout(9, 7, side)
    blocks, whole = {"gaussian": (bl.gaussian_blocks, morphology.gaussian_blur), "box": (bl.box_blocks, morphology.box_mean)}[name]
    got, wanted = images_of(bl.from_blocks(blocks(bl.to_blocks(f, at), at, option), at)), images_of(whole(f, option))
    assert all(np.allclose(got[i], wanted[i], equal_nan=True, atol=1e-12) for i in wanted) and not all(np.isnan(m).all() for m in got.values())


def flooded(hit):
    """The first pixel of each hit's cluster, by flood fill."""
    first = {}
    for start in map(tuple, np.argwhere(hit)):
        waiting = [start] if start not in first else []
        while waiting:
            y, x = waiting.pop()
            if 0 <= y < hit.shape[0] and 0 <= x < hit.shape[1] and hit[y, x] and (y, x) not in first:
                first[y, x] = start
                waiting += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return first


def snake(n):
    """One path through all of a square, back and forth."""
    out = np.zeros((n, n))
    out[::2] = 1
    out[1::4, -1] = out[3::4, 0] = 1
    return out


def rings(n):
    y, x = np.mgrid[:n, :n]
    return ((np.maximum(abs(y - n // 2), abs(x - n // 2)) % 2) == 0).astype(float)


@pytest.mark.parametrize("side", [2, 3, 8])
def test_clusters_are_those_of_a_flood_fill(spark, side):
    rng = np.random.default_rng(side)
    images = [snake(21), rings(21), np.ones((21, 21)), np.zeros((21, 21)), *(rng.random((3, 21, 21)) < [[[0.4]], [[0.6]], [[0.1]]]).astype(float)]
    at = Layout(21, 21, side)
    found = bl.cluster_blocks(bl.to_blocks(frames_of(spark, images), at).withColumnRenamed("v", "hit"), at).collect()
    for i, m in enumerate(images):
        assert {(r.r, r.c): (r.first_r, r.first_c) for r in found if r.frame_id == i} == flooded(m == 1)


def test_components_stay_inside_their_groups(spark):
    rng = np.random.default_rng(3)
    edges = [(g, int(a), int(b)) for g in range(3) for a, b in rng.integers(0, 60, (40, 2))] + [(9, a, b) for a, b in pairwise(range(100))]
    found = {(r.g, r.node): r.root for r in components(spark.createDataFrame(edges, "g int, a int, b int")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for g, a, b in edges:
        low, high = sorted((find((g, a)), find((g, b))))
        root[high] = low
    wanted = {x: find(x)[1] for g, a, b in edges if a != b for x in ((g, a), (g, b))}
    assert found == wanted and found[9, 99] == 0


def chain(spark, n, frames=3, seed=5):
    """A bright ring per frame, noise, and a few hot pixels with bright neighbours."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:n, :n]
    images = []
    for _ in range(frames):
        d = np.hypot(x - n / 2 - rng.normal(), y - n / 2 - rng.normal())
        m = 50 * np.exp(-((d - n / 5) ** 2) / n) + rng.random((n, n))
        for _ in range(5):
            r, c = rng.integers(1, n - 1, 2)
            m[r, c], m[r, c + 1] = 900, 400
        images.append(m)
    f = frames_of(spark, images).withColumn("filename", F.format_string("f%d", "frame_id")).withColumn("xps_value", F.lit(1.0))
    zero = lookups.grid(spark, n, n).withColumn("bg", F.lit(0.25))
    s = Settings(n, n, (n / 2 + 1, n / 2 - 1), ring=(n / 10, n / 3), radius=n // 2, bins=8, sigma=20, ratio=0.5, box=2, tolerance=0.1)
    return f, zero, lookups.corner_masks(spark, n, n, max(2, n // 16)), s


def close(a, b):
    assert a.error == b.error and a.filename == b.filename
    for c in ("center_x", "center_y", "total_count"):
        assert getattr(a, c) == pytest.approx(getattr(b, c), rel=1e-9, abs=1e-9)
    assert a.radial_profile == pytest.approx(b.radial_profile, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("side", [5, 8, 64])
def test_the_chain_on_blocks_is_that_on_frames(spark, side):
    f, zero, masks, s = chain(spark, 24, frames=6)
    f = f.withColumn("pixels", F.when(F.col("frame_id") == 2, F.slice("pixels", 1, 9)).otherwise(F.col("pixels")))
    a, b = ({r.frame_id: r for r in rows.collect()} for rows in (process_blocks(f, zero, masks, s, side=side), process_frames(f, zero, masks, s)))
    assert set(a) == set(b) and a[2].error
    for i in set(a) - {2}:
        close(a[i], b[i])


def timed(work):
    start = time.time()
    out = work()
    return time.time() - start, out


@pytest.mark.parametrize("process", [process_pixels, process_blocks])
def test_the_chain_grows_with_the_pixels(spark, process):
    """From 128 to 512 pixels a side, 16 times as many: far from the 256 times of a quadratic step, and equal to frames."""
    timed(lambda: process(*chain(spark, 64, 1)).collect())
    small, _ = timed(lambda: process(*chain(spark, 128, 1)).collect())
    large, found = timed(lambda: process(*chain(spark, 512, 1)).collect())
    assert large < 32 * small + 5
    close(found[0], process_frames(*chain(spark, 512, 1)).first())


def test_pixels_to_frames_grows_with_the_pixels(spark):
    """A frame of 512 x 512 with gaps; a pixel that is there twice is an error."""
    n = 512
    f = spark.range(1).select(F.col("id").alias("frame_id"), F.lit(1.0).alias("xps_value"), F.lit(n).alias("height"), F.lit(n).alias("width"), F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda x: x.cast("double")).alias("pixels"))
    some = to_pixels(f).where("(7 * r + 3 * c) % 11 <> 0")
    took, back = timed(lambda: images_of(to_frames(some, n, n))[0])
    y, x = np.mgrid[:n, :n]
    wanted = np.where((7 * y + 3 * x) % 11 != 0, y * n + x, np.nan)
    assert np.array_equal(back, wanted, equal_nan=True) and took < 30
    few = to_pixels(frames_of(spark, noise(2, 3, 3)))
    with pytest.raises(Exception, match="not one value for each pixel"):
        to_frames(few.unionByName(few.where("frame_id = 1 AND r = 1")), 3, 3).collect()
