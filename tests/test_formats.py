"""TIFF layouts, the source that reads only what filters let through, and files that appear all at once."""

import os
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringContains

from ringlake.sources import formats, tiff
from ringlake.sources.files import write_files
from ringlake.sources.formats import FrameReader, frame_source, save_files

TILES = [None, (16, 16), (3, 5)]


@pytest.mark.parametrize("compression", sorted(tiff.ENCODERS))
@pytest.mark.parametrize("order", ["<", ">"])
def test_layouts_and_back(compression, order):
    """All pixel types, predictors, strips and tiles, several images a file."""
    rng = np.random.default_rng(1)
    for kind in ("u1", "i2", "u4", "i8", "f4", "f8"):
        a = (rng.normal(size=(37, 21)) * 100).astype(kind)
        for predictor in (1, 2, 3) if kind[0] == "f" else (1, 2):
            for tile in TILES:
                data = tiff.encode_pages([a, a[:5, ::-1]], compression, predictor, tile, order)
                pages = tiff.decode_pages(data)
                assert len(pages) == 2 and pages[0].dtype == a.dtype and np.array_equal(pages[0], a) and np.array_equal(pages[1], a[:5, ::-1])
                assert np.array_equal(tiff.decode(data), a)


def test_strips_of_several_rows():
    a = np.arange(700 * 130, dtype=np.uint16).reshape(700, 130)
    data = tiff.encode_pages([a], "packbits", 2)
    assert len(tiff._directories(data)[1][0][tiff.STRIPS]) > 2 and np.array_equal(tiff.decode(data), a)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 255), st.integers(1, 300)), max_size=8))
def test_pack_bits(runs):
    data = b"".join(bytes([v]) * n for v, n in runs)
    packed = tiff.pack_bits_encode(data)
    assert tiff.pack_bits_decode(packed) == data and len(packed) <= len(data) + len(data) // 128 + 8
    assert tiff.pack_bits_decode(b"\x80" + packed) == data  # a length that stands for nothing


def patched(data, tag, value):
    """The file with another value of a tag of its first image."""
    at = struct.unpack("<I", data[4:8])[0]
    n = struct.unpack("<H", data[at : at + 2])[0]
    for i in range(n):
        place = at + 2 + 12 * i
        if struct.unpack("<H", data[place : place + 2])[0] == tag:
            return data[: place + 8] + struct.pack("<I", value) + data[place + 12 :]
    raise AssertionError(tag)


@pytest.mark.parametrize("tag,value,what", [(tiff.COMPRESSION, 7, "compression 7"), (tiff.SAMPLES, 3, "3 samples"), (tiff.BITS, 12, "12 bits"), (tiff.PREDICTOR, 9, "predictor 9"), (tiff.KIND, 6, "sample format 6"), (tiff.PREDICTOR, 3, "byte differences"), (tiff.HEIGHT, 0, "no pixels")])
def test_other_layouts_are_named(tag, value, what):
    data = patched(tiff.encode_pages([np.ones((4, 4), np.uint16)], "plain"), tag, value)
    with pytest.raises(ValueError, match=what):
        tiff.decode(data)


def test_broken_files():
    data = tiff.encode_pages([np.ones((40, 40))], "plain")
    for broken, what in ((b"", "not a TIFF"), (data[:9], "broken chain"), (b"II*\0\0\0\0\0", "without an image"), (data[:4] + struct.pack("<I", len(data) + 50) + data[8:], "broken chain"), (b"II+\0" + data[4:], "64-bit offsets"), (patched(data, tiff.COUNTS, 99), "truncated")):
        with pytest.raises(ValueError, match=what):
            tiff.decode_pages(broken)
    at = struct.unpack("<I", data[4:8])[0]
    n = struct.unpack("<H", data[at : at + 2])[0]
    end = at + 2 + 12 * n
    with pytest.raises(ValueError, match="broken chain"):  # a directory that follows itself
        tiff.decode_pages(data[:end] + struct.pack("<I", at) + data[end + 4 :])


def folder_of(tmp_path, values=(1, 2, 3), files=4):
    for v in values:
        for i in range(files):
            (tmp_path / f"c_xps120.00{v}_s{i}.tif").write_bytes(tiff.encode_pages([np.full((2, 3), v * 10 + i), np.full((2, 3), -v)], "lzw"))
    (tmp_path / "other.tiff").write_bytes(tiff.encode(np.ones((2, 2))))
    (tmp_path / "notes.txt").write_text("no frame")
    return str(tmp_path)


def names(reader):
    return sorted(p.rsplit("/", 1)[-1] for part in reader.partitions() for p in part.paths)


@pytest.mark.parametrize("filters,kept,left", [
    ([EqualTo(("xps_value",), 120.002)], 4, 0), ([In(("xps_value",), (120.001, 120.003))], 8, 0), ([GreaterThan(("xps_value",), 120.001), StringContains(("filename",), "s3")], 2, 0),
    ([IsNotNull(("xps_value",))], 12, 0), ([EqualTo(("height",), 2)], 13, 1), ([EqualTo(("xps_value",), 1.0)], 0, 0), ([EqualTo(("xps_value",), None)], 0, 0), ([], 13, 0),
])
def test_filters_on_names_are_planned(tmp_path, filters, kept, left):
    reader = FrameReader({"path": folder_of(tmp_path)})
    assert len(list(reader.pushFilters(filters))) == left and len(names(reader)) == kept


def test_partitions_are_runs_of_files(tmp_path):
    path = folder_of(tmp_path)
    assert len(FrameReader({"path": path}).partitions()) == 1
    one_each = FrameReader({"path": path, "partitionbytes": "1"})
    assert len(one_each.partitions()) == 13 and names(one_each) == names(FrameReader({"path": path}))


def test_small_files_fill_a_partition_by_their_number(tmp_path):
    reader = FrameReader({"path": folder_of(tmp_path), "partitionbytes": str(4 * 32 * 1024)})
    assert [len(p.paths) for p in reader.partitions()] == [4, 4, 4, 1]


def test_a_task_reads_batches_of_bounded_size(tmp_path, monkeypatch):
    path = folder_of(tmp_path)
    (tmp_path / "a_broken.tiff").write_bytes(b"broken")
    monkeypatch.setattr(formats, "BATCH_BYTES", 100, raising=False)
    reader = FrameReader({"path": path})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    rows = [r for b in batches for r in b.to_pylist()]
    assert len(batches) > 3 and len(rows) == 14 and all(b.num_rows == 1 or sum(8 * len(x or ()) for x in b.column("pixels").to_pylist()) <= 100 for b in batches)
    for r in rows:
        if "broken" in r["filename"]:
            assert r["error"] and r["pixels"] is None and r["height"] is None
        else:
            assert r["error"] is None and r["pixels"] == tiff.decode(open(r["path"], "rb").read()).astype(float).ravel().tolist()


def test_files_that_a_filter_drops_are_not_opened(spark, tmp_path):
    """They can't be: they are folders' worth of nothing by then. The rows are those of the reader of binary files."""
    path = folder_of(tmp_path)
    wanted = {(r.filename, r.xps_value, r.height, tuple(r.pixels)) for r in tiff.read_frames(spark, path).where("xps_value = 120.002").collect()}
    for f in os.listdir(path):
        if "120.002" not in f:
            (tmp_path / f).write_bytes(b"broken")
    chosen = frame_source(spark, path, partitionBytes=1).where("xps_value = 120.002")
    assert chosen.rdd.getNumPartitions() == 4
    rows = chosen.collect()
    assert {(r.filename, r.xps_value, r.height, tuple(r.pixels)) for r in rows} == wanted and not any(r.error for r in rows)
    all_ = frame_source(spark, path).collect()
    assert len(all_) == 13 and sum(r.error is not None for r in all_) == 9
    assert frame_source(spark, path).where("xps_value = 7").collect() == []


def test_each_image_of_a_file_is_a_frame(spark, tmp_path):
    path = folder_of(tmp_path, values=(5,), files=1)
    for rows in (frame_source(spark, path, pages="true").where("xps_value IS NOT NULL").collect(), tiff.read_frames(spark, path, pages=True).where("xps_value IS NOT NULL").collect()):
        assert sorted((r.page, r.pixels[0]) for r in rows) == [(0, 50.0), (1, -5.0)]
    assert len({r.frame_id for r in tiff.read_frames(spark, path, pages=True).collect()}) == 3


def made(spark, names_):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names_)], "name string, i int").repartition(3)


def visible(folder):
    return sorted(f for f in os.listdir(folder) if not f.startswith(("_", "."))) if os.path.exists(folder) else []


def test_files_appear_all_at_once_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "out")

    def content(row):
        if row.i == 7:
            raise ValueError("the seventh fails")
        return b"x" * row.i

    with pytest.raises(Exception, match="the seventh fails"):
        write_files(made(spark, [f"f{i}" for i in range(12)]), out, "name", content)
    assert visible(out) == [] and not [f for f in os.listdir(out) if f.startswith("_temporary")] if os.path.exists(out) else True
    assert write_files(made(spark, [f"f{i}" for i in range(12)]), out, "name", lambda row: b"x" * row.i) == 12
    assert visible(out) == sorted(f"f{i}" for i in range(12)) and os.path.getsize(f"{out}/f9") == 9
    assert not [f for f in os.listdir(out) if f.startswith("_temporary")]


def test_equal_names_are_an_error(spark, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(Exception, match="two rows have the name b"):
        write_files(made(spark, ["a", "b", "c", "b"]), out, "name", lambda row: b"1")
    assert visible(out) == []
    assert write_files(made(spark, ["a", "b"]), out, "name", lambda row: b"1") == 2
    with pytest.raises(Exception, match="b is there already"):
        write_files(made(spark, ["b", "c"]), out, "name", lambda row: b"2")
    assert visible(out) == ["a", "b"] and open(f"{out}/b").read() == "1"
    assert write_files(made(spark, ["b", "c"]), out, "name", lambda row: b"2", overwrite=True) == 2
    assert visible(out) == ["a", "b", "c"] and open(f"{out}/b").read() == "2"


def test_names_of_other_places_and_no_rows(spark, tmp_path):
    out = str(tmp_path / "out")
    for bad in ("../x", "_hidden", ""):
        with pytest.raises(Exception, match="not a name for a file"):
            write_files(made(spark, [bad]), out, "name", lambda row: b"1")
    assert save_files(spark.createDataFrame([], "name string, content binary"), out) == 0 and visible(out) == []
    with pytest.raises(Exception, match="name string, content binary"):
        save_files(made(spark, ["a"]).select("name", F.col("i")), out)
