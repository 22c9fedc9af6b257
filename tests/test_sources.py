"""Files: TIFF and PNG round trips, results, failures, configuration, and the file stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringlake.operators import lookups
from ringlake.plans import run
from ringlake.plans.pipeline import Settings, process_frames, process_pixels, run_directory, split_failures
from ringlake.sources import masks, results, tiff
from ringlake.streaming.frames import append_results, frame_stream

SETTINGS = Settings(16, 16, (8.0, 8.0), ring=(1, 6), radius=6, bins=3, box=2)


@pytest.fixture
def folder(tmp_path):
    """Nine frames of three scan positions, a broken file, and a file without a scan token."""
    rng = np.random.default_rng(0)
    for i in range(9):
        tiff.write_one((rng.random((16, 16)) * 1000).astype(np.uint16), str(tmp_path / f"Cam-{i}_xps1.{i % 3}0_scan.tiff"), compress=i % 2 == 0)
    (tmp_path / "Cam-9_xps1.00_scan.tiff").write_bytes(b"II*\0broken")
    tiff.write_one(np.ones((16, 16), np.uint8), str(tmp_path / "Cam-10_noxps0_x.tiff"))
    return tmp_path


def constants(spark):
    return lookups.grid(spark, 16, 16).withColumn("bg", F.lit(0.0)), lookups.corner_masks(spark, 16, 16, 2)


@pytest.mark.parametrize("kind", ["u1", "u2", "u4", "i2", "i4", "f4", "f8"])
@pytest.mark.parametrize("compress", [False, True])
def test_tiff_round_trip(kind, compress):
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (7, 13), (130, 300)):
        a = (rng.random(shape) * 100).astype(kind)
        b = tiff.decode(tiff.encode(a, compress))
        assert b.dtype == a.dtype and np.array_equal(a, b)


def test_lzw_tables_fill_and_start_again():
    for data in (b"", b"a", b"a" * 100_000, bytes(np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8)), bytes(range(256)) * 300):
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_both_byte_orders():
    import struct

    a = np.arange(6, dtype=">u2").reshape(2, 3)
    entries = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, 8), (279, 4, 1, 12)]
    body = b"".join(struct.pack(">HHI", t, k, n) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, n, v in entries)
    data = b"MM\0*" + struct.pack(">I", 20) + a.tobytes() + struct.pack(">H", len(entries)) + body + b"\0" * 4
    assert np.array_equal(tiff.decode(data), a)


@pytest.mark.parametrize("bad", [np.zeros((0, 3)), np.zeros(3), "text", np.zeros((2, 2), np.complex64)])
def test_what_is_no_frame_is_not_written(bad):
    with pytest.raises(ValueError):
        tiff.encode(bad)


def test_suffixes(tmp_path):
    a = np.arange(4.0).reshape(2, 2)
    assert tiff.write_one(a, str(tmp_path / "sub/x.png")).endswith("sub/x.tiff")
    assert np.array_equal(tiff.read_one(str(tmp_path / "sub/x")), a)
    (tmp_path / "y.tif").write_bytes(tiff.encode(a))
    assert np.array_equal(tiff.read_one(str(tmp_path / "y")), a)


def test_a_folder_of_frames(spark, folder):
    frames = tiff.read_frames(spark, str(folder))
    assert frames.count() == 11 and tiff.list_files(spark, str(folder)).count() == 11
    assert [r.filename for r in tiff.failures(frames).collect()] == ["Cam-9_xps1.00_scan.tiff"]
    assert {r.xps_value for r in frames.where("error IS NULL").collect()} == {1.0, 1.1, 1.2, None}


def test_png_masks():
    grey = np.random.default_rng(2).integers(0, 256, (9, 11), dtype=np.uint8)
    assert np.array_equal(masks.decode_png(masks.encode_png(grey)), grey)
    assert np.array_equal(masks.mask_of_png(masks.encode_png(grey)), (grey >= 128).astype(int))
    colour = np.stack([grey] * 3, axis=-1)
    assert np.array_equal(masks.decode_png(masks.encode_png(colour)), grey)
    assert masks.decode_png(masks.image_of_frame(np.full((3, 3), 5.0))).max() == 0
    with pytest.raises(ValueError):
        masks.decode_png(b"no image")


def test_run_of_a_folder(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("run") / "out")
    run_directory(spark, str(folder), out, *constants(spark), SETTINGS)
    rows = results.load_results(spark, f"{out}/results", 3).collect()
    assert len(rows) == 9 and all(len(r.radial_profile) == 3 for r in rows)
    lost = spark.read.option("header", True).csv(f"{out}/failed").collect()
    assert [r.filename for r in lost] == ["Cam-9_xps1.00_scan.tiff"]
    with pytest.raises(Exception, match="(?i)exist"):
        run_directory(spark, str(folder), out, *constants(spark), SETTINGS)
    run_directory(spark, str(folder), f"{out}2", *constants(spark), SETTINGS, process=process_pixels)
    other = {r.filename: r for r in results.load_results(spark, f"{out}2/results", 3).collect()}
    assert len(other) == 9 and all(abs(other[r.filename].center_x - r.center_x) < 1e-9 for r in rows)
    assert spark.read.option("header", True).csv(f"{out}2/failed").count() == 1


def test_masks_of_a_folder(spark, tmp_path):
    rng = np.random.default_rng(4)
    grey = {f"m{i}.png": rng.integers(0, 256, (3 + i, 5), dtype=np.uint8) for i in range(3)}
    for name, g in grey.items():
        (tmp_path / name).write_bytes(masks.encode_png(g))
    (tmp_path / "broken.PNG").write_bytes(b"\x89PNG")
    found = masks.read_masks(spark, str(tmp_path)).cache()
    assert sorted((r.path.rsplit("/", 1)[-1], r.error is None) for r in found.collect()) == [("broken.PNG", False), ("m0.png", True), ("m1.png", True), ("m2.png", True)]
    rows = masks.mask_pixels(found).collect()
    assert len(rows) == 5 * (3 + 4 + 5) and all(r.keep == int(grey[r.path.rsplit("/", 1)[-1]][r.r, r.c] >= 128) for r in rows)


def constant(spark, a, name):
    return spark.createDataFrame([(name, *a.shape, [float(v) for v in a.ravel()])], "filename string, height int, width int, pixels array<double>")


def test_background_and_masks_are_found(spark, tmp_path):
    """Default names beside the results; the first file of another folder; corners without masks; errors by name."""
    out, other, empty = (tmp_path / x for x in ("out", "other", "empty"))
    empty.mkdir()
    level = np.arange(16.0).reshape(4, 4)
    tiff.write_frames(constant(spark, level, "background"), str(out))
    tiff.write_frames(constant(spark, level + 1, "b"), str(other))
    tiff.write_one(level + 2, str(other / "c"))
    of = lambda rows, name: {(r.r, r.c): r[name] for r in rows.collect()}
    config = results.RunConfig(str(out), "default", "default")
    assert of(run.resolve_background(spark, config, 4, 4), "bg")[1, 2] == 6.0
    assert of(run.resolve_background(spark, results.RunConfig(str(out), str(other), "default"), 4, 4), "bg")[1, 2] == 7.0
    with pytest.raises(FileNotFoundError):
        run.resolve_background(spark, results.RunConfig(str(out), str(empty), ""), 4, 4)
    with pytest.raises(FileNotFoundError):
        run.resolve_background(spark, results.RunConfig(str(empty), "default", ""), 4, 4)
    with pytest.raises(Exception, match="not 5 x 4"):
        run.resolve_background(spark, config, 5, 4).collect()
    corners = of(lookups.corner_masks(spark, 4, 4, 2), "bkg")
    assert of(run.resolve_masks(spark, config, 4, 4), "bkg") == corners
    assert of(run.resolve_masks(spark, results.RunConfig(str(out), "", str(tmp_path / "nowhere")), 4, 4), "keep") == dict.fromkeys(corners, 1)
    keep = (level > 3).astype(np.uint8)
    tiff.write_one(keep, str(out / "data_mask"))
    assert of(run.resolve_masks(spark, config, 4, 4), "keep")[0, 1] == 0 and of(run.resolve_masks(spark, config, 4, 4), "bkg") == corners
    tiff.write_one(1 - keep, str(out / "background_mask"))
    assert of(run.resolve_masks(spark, config, 4, 4), "bkg")[0, 1] == 1


def test_configured_run_and_merged_groups(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("configured"))
    tiff.write_one(np.zeros((16, 16)), f"{out}/background")
    config = results.RunConfig(out, "default", "default", center_fitting_param=[1, 6, 8, 8], azimuthal_avg_param=[6, 3])
    made = run.run_configured(spark, config, str(folder), 16, 16)
    assert results.load_results(spark, f"{made}/results", 3).count() == 9
    frames = tiff.read_frames(spark, str(folder)).where("error IS NULL")
    merged = run.merged_frames(frames, large=2, gap=0.15)
    assert merged.columns == frames.columns and {round(r.xps_value, 9) for r in merged.collect()} == {1.1} and merged.count() == 9
    assert {r.xps_value for r in run.merged_frames(frames, large=2, gap=0.01, first=2).collect()} == {1.0, 1.1}
    assert run.process_merged(frames, *constants(spark), SETTINGS, large=2, gap=0.01, first=1).where("error IS NULL").count() == 3


def test_results_append_and_report(spark, tmp_path):
    rows = [("a", 1.0, 2.0, 3.0, 1.5, [1.0, None]), ("b", 3.0, 2.0, 3.0, 1.5, [3.0, 1.0])]
    r = spark.createDataFrame(rows, "filename string, center_x double, center_y double, total_count double, xps_value double, radial_profile array<double>")
    for _ in range(2):
        results.save_results(r, str(tmp_path / "r"), 2)
    assert results.load_results(spark, str(tmp_path / "r"), 2).count() == 4
    results.save_results_csv(r, str(tmp_path / "c"), 2)
    assert "radial_bin_1" in spark.read.option("header", True).csv(str(tmp_path / "c")).columns
    sections = results.report(r, 2)
    assert {x.bin: x["mean"] for x in sections["profile"].collect()}[0] == "2.000000"
    assert sections["centres"].collect()[0].center_x == "1.000"
    results.save_failures(r.select("filename", F.lit("e").alias("error")).where("false"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_configuration(spark, tmp_path):
    given = results.RunConfig.of({"result_directory": "/out", "xray_removal_param": [5.0, 0.5], "unknown": 1})
    results.save_config(spark, given, str(tmp_path / "config"))
    assert results.load_config(spark, str(tmp_path / "config")) == given


def test_a_batch_that_is_run_again_replaces_itself(spark, folder, tmp_path_factory):
    """A batch whose results were written but not committed comes again under its number."""
    base = tmp_path_factory.mktemp("replay")
    process = lambda batch: split_failures(process_frames(batch.where("xps_value IS NOT NULL"), *constants(spark), SETTINGS))[0].drop("frame_id")
    append_results(frame_stream(spark, str(folder), 4), process, str(base / "out"), 3, str(base / "cp")).awaitTermination()
    last = max((base / "cp/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for f in (last, last.with_name(f".{last.name}.crc")):
        f.unlink(missing_ok=True)
    append_results(frame_stream(spark, str(folder), 4), process, str(base / "out"), 3, str(base / "cp")).awaitTermination()
    assert results.load_results(spark, str(base / "out"), 3).count() == 9


def test_stream_of_files(spark, folder, tmp_path_factory):
    base = tmp_path_factory.mktemp("stream")

    def process(batch):
        readable = batch.where("error IS NULL AND xps_value IS NOT NULL").drop("error")
        return split_failures(process_frames(readable, *constants(spark), SETTINGS))[0].drop("frame_id")

    for _ in range(2):  # a second start finds nothing new
        append_results(frame_stream(spark, str(folder), 4), process, str(base / "out"), 3, str(base / "cp")).awaitTermination()
        assert results.load_results(spark, str(base / "out"), 3).count() == 9
