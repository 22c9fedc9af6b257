"""Operators on planted frames: known centres, injected hits, borders, missing pixels, ties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringlake.operators import background as bg
from ringlake.operators import centroid, fitting, grouping, lookups, morphology, outliers, radial, summary
from ringlake.operators.frames import normalise, require_one_shape, require_pixels, shift, subtract, to_frames, to_pixels
from ringlake.operators.masking import apply_masks
from ringlake.plans.pipeline import Settings, process_frames, screening_image, split_failures

FRAMES = "frame_id long, filename string, xps_value double, height int, width int, pixels array<double>"


@pytest.fixture
def frames_of(spark):
    """A frames table from arrays; all in one group unless groups are given."""

    def make(arrays, groups=None):
        rows = [(i, f"f{i}", (groups or {}).get(i, 1.0), *a.shape, [float(v) for v in a.ravel()]) for i, a in enumerate(arrays)]
        return spark.createDataFrame(rows, FRAMES)

    return make


def image(pixels, shape, frame=0, value="v"):
    out = np.full(shape, np.nan)
    for r in pixels.where(F.col("frame_id") == frame).collect() if "frame_id" in pixels.columns else pixels.collect():
        out[r.r, r.c] = np.nan if r[value] is None else r[value]
    return out


def ring_image(shape, x, y, radius=5.0, width=1.0, height=100.0):
    r, c = np.mgrid[: shape[0], : shape[1]]
    return height * np.exp(-((np.hypot(c - x, r - y) - radius) ** 2) / (2 * width**2))


# frames


def test_pixels_and_back(frames_of):
    a = np.arange(12.0).reshape(3, 4)
    a[1, 2] = np.nan
    p = to_pixels(frames_of([a, a + 1]))
    assert p.count() == 24 and p.where("v IS NULL").count() == 2
    back = to_frames(p, 3, 4).orderBy("frame_id").collect()
    assert back[1].pixels == [None if math.isnan(v) else v + 1 for v in a.ravel().tolist()]


def test_shapes_must_agree(frames_of):
    same = frames_of([np.ones((2, 3)), np.ones((2, 3))])
    assert require_one_shape(same).count() == 2
    with pytest.raises(Exception, match="differ in shape"):
        require_one_shape(frames_of([np.ones((2, 3)), np.ones((3, 2))])).select("pixels").collect()


def test_shift_and_normalise(frames_of):
    a = np.arange(16.0).reshape(4, 4)
    moved = image(shift(to_pixels(frames_of([a])), 1, 2, 4, 4), (4, 4))
    assert np.array_equal(moved[:2, :3], a[2:, 1:]) and np.isnan(moved[2:]).all() and np.isnan(moved[:, 3]).all()
    assert np.allclose(image(normalise(to_pixels(frames_of([a]))), (4, 4)), a / 15)
    assert (image(normalise(to_pixels(frames_of([np.full((2, 2), 7.0)]))), (2, 2)) == 0).all()


# backgrounds and outliers


def test_backgrounds(frames_of):
    rng = np.random.default_rng(1)
    stack = [rng.normal(10, 1, (4, 4)) for _ in range(5)]
    stack[2][1, 1] = np.nan
    p = to_pixels(frames_of(stack))
    for method, f in (("mean", np.mean), ("median", np.median)):
        assert np.allclose(image(bg.mean_background(p, method), (4, 4), value="bg"), f(stack, axis=0), equal_nan=True)
    with pytest.raises(ValueError):
        bg.mean_background(p, "mode")
    filled = image(bg.fill_missing(bg.mean_background(p)), (4, 4), value="bg")
    assert filled[1, 1] == pytest.approx(np.nanmean(np.mean(stack, axis=0)))


def test_hysteresis_removes_hits_and_warm_neighbours_only(frames_of):
    rng = np.random.default_rng(2)
    quiet = [rng.normal(0, 1, (9, 9)) for _ in range(30)]
    hot = quiet[0].copy()
    hot[4, 4], hot[4, 5], hot[5, 5], hot[1, 1] = 1000, 9, 9, 9  # hit, its neighbour, a diagonal one, one far away
    p = to_pixels(frames_of([hot, *quiet]))
    stats = bg.pixel_statistics(p.where("frame_id > 0"))
    gone = np.isnan(image(outliers.hysteresis_filter(p, stats, 29.6, 0.2), (9, 9)))
    assert gone[4, 4] and gone[4, 5] and not gone[5, 5] and not gone[1, 1] and gone.sum() == 2
    boxed = bg.centre_box(stats, 4.0, 4.0, 4)
    assert not np.isnan(image(outliers.hysteresis_filter(p, boxed, 29.6, 0.2), (9, 9))).any()


def by_chunk(a, n, sigma, beam):
    out = a.copy()
    for i in range(0, a.shape[0], n):
        for j in range(0, a.shape[1], n):
            q = out[i : i + n, j : j + n]
            med = np.median(q)
            mad = np.median(np.abs(q - med))
            if med <= beam and (q > med + sigma * mad).any():
                q[q > med + 0.75 * sigma * mad] = np.nan
    return out


def test_chunk_filters(frames_of):
    rng = np.random.default_rng(3)
    a = rng.normal(5, 1, (8, 8))
    a[0, 0], a[0, 2] = 90, 12
    a[4:, 4:] += 500  # a bright chunk stays
    a[6, 6] = 9000
    p = to_pixels(frames_of([a]))
    assert np.allclose(image(outliers.mad_chunk_filter(p, 4, 8, 100), (8, 8)), by_chunk(a, 4, 8, 100), equal_nan=True)
    clipped = outliers.sigma_chunk_filter(p, 4, 2, 100)
    found = {(r.r, r.c) for r in clipped.where("removed").collect()}
    want = set()
    for i, j in ((0, 0), (0, 4), (4, 0), (4, 4)):
        q = a[i : i + 4, j : j + 4]
        if q.mean() <= 100:
            want |= {(i + y, j + x) for y, x in zip(*np.nonzero(q > q.mean() + 2 * q.std()))}
    assert found == want and (0, 0) in found
    with pytest.raises(ValueError):
        outliers.require_divisible(10, 8, 4)
    summary_row = morphology.removal_summary(clipped).collect()[0]
    assert summary_row.n_removed == len(want) and summary_row.n_pixels == 64


def test_dilation_is_monotone_and_stays_inside(frames_of):
    rng = np.random.default_rng(4)
    a = (rng.random((7, 6)) < 0.15).astype(float)
    grown = np.zeros_like(a, dtype=bool)
    for r, c in zip(*np.nonzero(a)):
        for y, x in ((r, c), (r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if 0 <= y < 7 and 0 <= x < 6:
                grown[y, x] = True
    flagged = to_pixels(frames_of([a])).withColumn("hit", F.col("v") > 0)
    got = image(flagged.withColumn("v", morphology.dilated("hit").cast("double")), (7, 6)) == 1
    assert (got == grown).all() and (got | (a > 0) == got).all()


def test_clusters(frames_of):
    a = np.zeros((6, 6))
    a[0, 0] = a[0, 1] = a[1, 1] = 1
    a[2, 2] = 1  # diagonal: its own cluster
    a[4, 1:6] = a[5, 1:6] = 1
    sizes = morphology.cluster_sizes(morphology.clusters(to_pixels(frames_of([a])).where("v > 0")))
    assert {(r.first_r, r.first_c): r["size"] for r in sizes.collect()} == {(0, 0): 3, (2, 2): 1, (4, 1): 10}
    assert {r.size_class: r.n_clusters for r in morphology.size_histogram(sizes).collect()} == {"1": 1, "2-3": 1, "7-10": 1}


def test_blurs_keep_a_constant_and_reflect(frames_of):
    flat = to_pixels(morphology.gaussian_blur(frames_of([np.full((5, 5), 3.0)]), 1.0))
    assert np.allclose(image(flat, (5, 5)), 3)
    a = np.arange(20.0).reshape(4, 5)
    padded = np.pad(a, 1, mode="symmetric")
    want = sum(padded[y : y + 4, x : x + 5] for y in range(3) for x in range(3)) / 9
    assert np.allclose(image(to_pixels(morphology.box_mean(frames_of([a]), 3)), (4, 5)), want)
    with pytest.raises(ValueError):
        morphology.box_mean(frames_of([a]), 4)


def test_masks(frames_of, spark):
    a = np.arange(16.0).reshape(4, 4)
    masks = lookups.corner_masks(spark, 4, 4, 1).withColumn("keep", (F.col("c") != 2).cast("int"))
    got = image(apply_masks(to_pixels(frames_of([a])), masks), (4, 4))
    want = a - np.mean([0, 3, 12, 15])
    want[:, 2] = np.nan
    assert np.allclose(got, want, equal_nan=True)
    none = masks.withColumn("bkg", F.lit(1))
    assert np.isnan(image(apply_masks(to_pixels(frames_of([a])), none), (4, 4))).all()


# centres


def test_iterated_centroid_finds_a_planted_ring(frames_of):
    frames = frames_of([ring_image((40, 40), 19.3, 20.8), ring_image((40, 40), 22.3, 20.8)])
    got = {r.frame_id: r for r in centroid.iterative_centroid(frames, (20.0, 20.0), inner=2, outer=9, tolerance=0.01).collect()}
    assert (got[0].center_x, got[0].center_y) == (pytest.approx(19.3, abs=0.15), pytest.approx(20.8, abs=0.15))
    # a frame moved by whole pixels has its centre moved by as many
    assert got[1].center_x - got[0].center_x == pytest.approx(3, abs=0.05) and got[1].center_y == pytest.approx(got[0].center_y, abs=0.05)


def test_centroid_branches(frames_of):
    hole = ring_image((20, 20), 10, 10, 4)
    empty, negative = np.full((20, 20), np.nan), -np.ones((20, 20))
    p = to_pixels(frames_of([hole, empty, negative]))
    got = {r.frame_id: r for r in centroid.ring_centroid(p, (10.5, 9.5), 20, 20, 2, 6).collect()}
    assert (got[1].center_x, got[1].center_y, got[1].total_count) == (10.5, 9.5, 0.0)
    assert (got[2].center_x, got[2].center_y) == (10.0, 10.0) and got[2].total_count < 0  # halves go to the even side
    assert got[0].total_count > 0
    loop = {r.frame_id: r for r in centroid.iterative_centroid(frames_of([hole, empty, negative]), (10.5, 9.5), inner=2, outer=6).collect()}
    assert (loop[1].center_x, loop[1].center_y, loop[1].total_count) == (10.5, 9.5, 0.0)
    one_missing = hole.copy()
    one_missing[10, 14] = np.nan
    exact = centroid.ring_centroid_exact(to_pixels(frames_of([one_missing])), (10.2, 9.8), 2, 6).collect()[0]
    assert (exact.center_x, exact.center_y, exact.total_count) == (10.2, 9.8, None)


def test_gaussian_fit(frames_of):
    r, c = np.mgrid[:30, :30]
    a = 100 * np.exp(-((c - 14.4) ** 2 + (r - 15.7) ** 2) / (2 * 6.0**2)) + 3
    broken = a.copy()
    broken[15, 20] = np.nan
    got = {x.frame_id: x for x in fitting.gaussian_centres(frames_of([a, broken]), (80.0, 15.0, 15.0, 5.0, 1.0), 30, 30, 3, 12).collect()}
    assert got[0].success and [got[0][n] for n in fitting.NAMES] == pytest.approx([100, 14.4, 15.7, 6.0, 3], abs=1e-4)
    assert not got[1].success and got[1].x0 is None and got[1].total_intensity is None


# profiles


def test_profiles(frames_of, spark):
    flat = np.full((16, 16), 2.5)
    holes = flat.copy()
    holes[8, 8] = np.nan
    f = frames_of([flat, holes])
    centres = f.select("frame_id", F.lit(8.0).alias("center_x"), F.lit(8.0).alias("center_y"))
    rows = radial.azimuthal_average(to_pixels(f), centres, 16, 16, 10, 10).collect()
    assert len(rows) == 20 and all(x.mean == pytest.approx(2.5) for x in rows if not (x.frame_id == 1 and x.bin == 0))
    assert [x.mean for x in rows if x.frame_id == 1 and x.bin == 0] == [None]
    exact = {(x.frame_id, x.bin): x.mean for x in radial.azimuthal_average_exact(to_pixels(f), centres, 3, 6).collect()}
    assert exact[1, 0] is None and exact[0, 1] == 0.0 and exact[0, 2] == 2.5
    cells = lookups.radial(spark, 16, 16, 7, 14)
    r, c = np.mgrid[:16, :16]
    assert cells.count() == cells.select("r", "c").distinct().count() == int((np.hypot(c - 8, r - 8) < 7).sum())


def test_group_statistics_and_summary(spark):
    rows = [(1, 1.0, 0, 2.0), (2, 1.0, 0, 4.0), (1, 1.0, 1, 1.0), (2, 1.0, 1, None)]
    stats = {x.bin: (x.mean, x.std) for x in radial.profile_statistics(spark.createDataFrame(rows, "frame_id long, xps_value double, bin int, mean double")).collect()}
    assert stats == {0: (3.0, 1.0), 1: (None, None)}
    results = spark.createDataFrame([(1.0, 2.0, 3.0, 10.0, [1.0, 5.0]), (1.0, 4.0, 3.0, 20.0, [0.5, 2.0])], "xps_value double, center_x double, center_y double, total_count double, radial_profile array<double>")
    failed = spark.createDataFrame([(1.0,), (2.0,)], "xps_value double")
    got = {x.xps_value: x for x in summary.run_summary(results, failed).collect()}
    assert (got[1.0].mean_center_x, got[1.0].std_center_x, got[1.0].profile_max, got[1.0].profile_min) == (3.0, 1.0, 5.0, 0.5)
    assert got[1.0].success_rate == pytest.approx(2 / 3) and got[2.0].success_rate == 0


# groups


def merged_by_hand(groups, large, gap):
    big = sorted(g for g in groups if g[1] > large)
    clusters = []
    for x, n in big:
        if clusters and x - clusters[-1][-1][0] <= gap:
            clusters[-1].append((x, n))
        else:
            clusters.append([(x, n)])
    where = {x: k for k, c in enumerate(clusters) for x, _ in c}
    sums = [[sum(x * n for x, n in c), sum(n for _, n in c)] for c in clusters]
    for x, n in sorted(g for g in groups if g[1] <= large):
        if sums:
            k = min(range(len(sums)), key=lambda i: (abs(sums[i][0] / sums[i][1] - x), i))
            sums[k][0] += x * n
            sums[k][1] += n
            where[x] = k
    return {x: (k, sums[k][0] / sums[k][1]) for x, k in where.items()}


@pytest.mark.parametrize("seed", range(4))
def test_merging_against_a_loop(spark, seed):
    rng = random.Random(seed)
    groups = [(x / 1000, rng.choice([1, 5, 80, 400, 500])) for x in rng.sample(range(100), 30)]
    got = {r.xps_value: (r.cluster, r.merged_value) for r in grouping.merge_groups(spark.createDataFrame(groups, "xps_value double, n_files long")).collect()}
    want = merged_by_hand(groups, 350, 0.0025)
    assert {x: k for x, (k, _) in got.items()} == {x: k for x, (k, _) in want.items()}
    assert all(got[x][1] == pytest.approx(want[x][1]) for x in want)


def test_merging_without_a_large_group(spark):
    small = spark.createDataFrame([(1.0, 3), (2.0, 4)], "xps_value double, n_files long")
    assert grouping.merge_groups(small).count() == 0
    assert grouping.merge_groups(small, keep_small=True).count() == 2


def test_files_without_a_scan_token_are_left_out(spark):
    names = ["/d/C-1_xps1.50_scan1_a.tiff", "/d/C-2_xps1.50_scan2_b.tiff", "/d/C-3_noxps0_labtime.tiff", "/d/C-4_xps7_scan.tiff", "/d/C-5_xps0.25_x.tif"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    assert {(r.xps_value, r.n_files) for r in grouping.group_sizes(files).collect()} == {(1.5, 2), (0.25, 1)}
    assert {r.xps_value: r.n_patterns for r in grouping.pattern_summary(files).collect()} == {1.5: 2, 0.25: 1, None: 3}


def test_clusters_against_a_flood(frames_of):
    """Random hits in many frames, among them spirals and combs, whose clusters join late."""
    rng = np.random.default_rng(8)
    arrays = [(rng.random((13, 17)) < p).astype(float) for p in (0.0, 0.2, 0.45, 0.6, 0.9, 1.0) for _ in range(4)]
    comb = np.zeros((13, 17))
    comb[:, ::2] = 1
    comb[-1] = 1
    arrays += [comb, comb[::-1], comb[:, ::-1]]
    want = set()
    for i, a in enumerate(arrays):
        left = {tuple(map(int, q)) for q in np.argwhere(a > 0)}
        while left:
            first = min(left)
            found, stack = {first}, [first]
            while stack:
                r, c = stack.pop()
                near = {(r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)} & left - found
                found |= near
                stack += near
            left -= found
            want |= {(i, r, c, *first) for r, c in found}
    got = morphology.clusters(to_pixels(frames_of(arrays)).where("v > 0"))
    assert {tuple(r) for r in got.collect()} == want


def test_places_in_groups_of_any_size(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1.0] * 8 + [2.0, None]), f"f{i:05d}") for i in range(3000)]
    files = spark.createDataFrame(rows, "xps_value double, path string")
    got = {r.path: (r["__k"], r["__size"]) for r in grouping.placed(files, "xps_value", "path").collect()}
    for g in (1.0, 2.0, None):
        names = sorted(p for x, p in rows if x == g)
        assert [got[p] for p in names] == [(k, len(names)) for k in range(len(names))]


def test_parameters_are_refused_before_a_plan_is_made(frames_of):
    for bad in ({"ring": (5, 2)}, {"radius": 0}, {"bins": 0}, {"sigma": -1.0}, {"ratio": 2.0}, {"sample": 0}, {"height": 0}):
        with pytest.raises(ValueError):
            Settings(**{"height": 4, "width": 4, "guess": (1.0, 1.0), **bad})
    p = to_pixels(frames_of([np.ones((6, 8))]))
    for make in (outliers.mad_chunk_filter, outliers.sigma_chunk_filter, bg.filtered_background):
        with pytest.raises(ValueError):
            make(p, 4, shape=(6, 8))
        assert make(p, 2, shape=(6, 8)).count() == 48
    with pytest.raises(Exception, match="no pixels"):
        require_pixels(frames_of([np.ones((2, 2))]).withColumn("pixels", F.lit(None).cast("array<double>"))).collect()


def test_exact_profile_has_all_bins_of_every_frame(frames_of, spark):
    f = frames_of([np.ones((8, 8)), np.ones((8, 8))])
    centres = spark.createDataFrame([(0, 3.0, 3.0), (1, 100.0, 100.0), (7, 3.0, 3.0)], "frame_id long, center_x double, center_y double")
    got = radial.azimuthal_average_exact(to_pixels(f), centres, 3, 3).collect()
    assert sorted((r.frame_id, r.bin, r.mean) for r in got) == [(i, b, 1.0 if i == 0 else 0.0) for i in (0, 1, 7) for b in range(3)]


def test_selections(spark):
    groups = spark.createDataFrame([(2.0, 5), (1.0, 5), (3.0, 4)], "xps_value double, n_files long")
    longest = grouping.longest_group(groups)
    assert longest.collect()[0].xps_value == 1.0
    assert {r.xps_value for r in grouping.other_groups(groups, longest).collect()} == {2.0, 3.0}
    assert grouping.nth_group(groups, 1).collect()[0].xps_value == 2.0
    files = spark.createDataFrame([(1.0, f"f{i:03d}") for i in range(23)] + [(2.0, "a")], "xps_value double, path string")
    picked = [r.path for r in grouping.evenly_spaced(files, 5).orderBy("path").collect()]
    assert picked == ["a", *(f"f{i:03d}" for i in (0, 5, 11, 16, 22))]
    sample = sorted(r.path for r in grouping.hash_sample(files, 7).collect())
    assert len(sample) == 8 and sample == sorted(r.path for r in grouping.hash_sample(files.repartition(5), 7).collect())


# whole chain


def settings(**more):
    return Settings(24, 24, (12.0, 12.0), ring=(2, 8), radius=10, bins=5, box=4, **more)


def test_a_bad_frame_fails_alone(frames_of, spark):
    rng = np.random.default_rng(6)
    good = [ring_image((24, 24), 12.4, 11.7, 5) + rng.normal(0, 0.1, (24, 24)) for _ in range(6)]
    f = frames_of([*good, np.ones((3, 3))])
    zero = lookups.grid(spark, 24, 24).withColumn("bg", F.lit(0.0))
    done, failed = split_failures(process_frames(f.where("height = 24").unionByName(f.where("height = 3")), zero, lookups.corner_masks(spark, 24, 24, 3), settings()))
    rows = done.collect()
    assert len(rows) == 6 and all(abs(r.center_x - 12.4) < 0.3 and abs(r.center_y - 11.7) < 0.3 for r in rows)
    assert [(r.filename, "3 x 3" in r.error) for r in failed.collect()] == [("f6", True)]


def test_screening_image(frames_of, spark):
    f = frames_of([np.full((24, 24), float(i)) for i in range(8)], {7: 2.0})
    zero = lookups.grid(spark, 24, 24).withColumn("bg", F.lit(1.0))
    rows = screening_image(f, zero, settings(), k=0, size=3).collect()
    assert len(rows) == 576 and {r.xps_value for r in rows} == {1.0} and {r.v for r in rows} == {2.0}


def test_subtract_keeps_missing_pixels(frames_of, spark):
    a = np.array([[1.0, np.nan], [3.0, 4.0]])
    one = lookups.grid(spark, 2, 2).withColumn("bg", F.lit(1.0))
    assert np.allclose(image(subtract(to_pixels(frames_of([a])), one), (2, 2)), a - 1, equal_nan=True)


def test_fits_of_many_frames_are_those_of_each(frames_of):
    """Stacked steps give what one frame alone gives; parameters stop at their bounds; each frame ends on its own."""
    rng = np.random.default_rng(6)
    r, c = np.mgrid[:24, :24]
    start = (80.0, 12.0, 11.0, 5.0, 1.0)
    images = [a * np.exp(-((c - x) ** 2 + (r - y) ** 2) / (2 * s * s)) + 2 + rng.normal(size=r.shape) / 4 for a, x, y, s in ((100, 12.5, 11.1, 5, ), (900, 12.0, 11.0, 5), (60, 9.0, 14.0, 3), (90, 12.0, 12.0, 0.4))]
    images.append(np.full(r.shape, 3.0))
    x, y, v = c.ravel().astype(float), r.ravel().astype(float), np.stack([m.ravel() for m in images])
    good, p, errors = fitting.fit_rings(x, y, v, start, 24, 24)
    low, high = fitting.bounds_of(start, 24, 24)
    assert good.all() and (p >= low).all() and (p <= high).all() and p[1, 0] == 400 and p[3, 3] == 1.0
    for i in range(len(images)):
        alone = fitting.fit_rings(x, y, v[i : i + 1], start, 24, 24)
        assert alone[1][0] == pytest.approx(p[i], rel=1e-9) and alone[2][0] == pytest.approx(errors[i], rel=1e-6, nan_ok=True)
    for i in (0, 2):  # at a free optimum no small step lowers the cost
        f = lambda q: ((fitting._model(q[None], x, y)[0][0] - v[i]) ** 2).sum()  # noqa: B023, E731
        assert all(f(p[i] + d) >= f(p[i]) for d in np.concatenate([np.eye(5), -np.eye(5)]) * 1e-5)
        assert 0 < errors[i, 1] < 0.1


def test_frames_without_a_fit(frames_of, spark):
    """Other sizes, no pixels, too few pixels in the ring, a start outside its bounds: a row each, without success."""
    f = frames_of([np.ones((8, 8))] * 3).withColumn("pixels", F.when(F.col("frame_id") == 1, F.slice("pixels", 1, 9)).when(F.col("frame_id") == 0, F.col("pixels")))
    got = {x.frame_id: x for x in fitting.gaussian_centres(f, (1.0, 4.0, 4.0, 2.0, 0.0), 8, 8, 0, 3).collect()}
    assert (got[0].success, got[1].success, got[2].success) == (True, False, False) and got[1].n_pixels == got[2].n_pixels == 0
    for start, ring in (((1.0, 4.0, 4.0, 2.0, 0.0), (0, 1)), ((-1.0, 4.0, 4.0, 2.0, 0.0), (0, 3)), ((1.0, 40.0, 4.0, 2.0, 0.0), (0, 90))):
        assert not any(x.success for x in fitting.gaussian_centres(f, start, 8, 8, *ring).collect())
    assert fitting.gaussian_centres(f.limit(0), (1.0, 4.0, 4.0, 2.0, 0.0), 8, 8).collect() == []


def test_one_fit_feeds_the_profile(spark):
    """The fit is in the plan once, and frames meet no join."""
    from ringlake.plans.catalog import QUERIES

    plan = QUERIES["i4_fitted_profile"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


@pytest.mark.parametrize("filtered", [outliers.mad_chunk_filter, outliers.sigma_chunk_filter])
def test_frames_of_no_whole_chunks_are_an_error(frames_of, filtered):
    """Without the shape being told: 6 x 8 pixels are no chunks of 4, 8 x 8 are."""
    with pytest.raises(Exception, match="frame 0 has no whole chunks of 4"):
        filtered(to_pixels(frames_of([np.ones((6, 8))])), 4).collect()
    assert filtered(to_pixels(frames_of([np.ones((8, 8))])), 4).count() == 64
