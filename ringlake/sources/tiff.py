"""TIFF frames: a reader over Spark's binary files and a writer.

Images of one sample a pixel, of 8, 16, 32 or 64 bits, signed, unsigned or floating point, in
either byte order; one or a chain of them a file; in strips or tiles; plain, LZW, Deflate or
PackBits; with differences along rows reversed, of whole numbers or of a float's bytes. What
else there is in the format is an error that names it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlake.functions.naming import base_name, scan_value
from ringlake.sources.files import write_files

# Fixed values of the TIFF format: tags, field types (code and bytes), compression and sample kinds.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIPS, SAMPLES, ROWS, COUNTS, PREDICTOR, KIND = 256, 257, 258, 259, 262, 266, 273, 277, 278, 279, 317, 339
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS = 322, 323, 324, 325
FIELDS = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACK_BITS = 1, 5, 8, 32946, 32773
NO_PREDICTOR, DIFFERENCES, FLOAT_DIFFERENCES = 1, 2, 3
KINDS = {1: "u", 2: "i", 3: "f"}
CLEAR, END, FIRST = 256, 257, 258

FRAMES = "frame_id long, path string, filename string, height int, width int, dtype string, pixels array<double>, error string"


def _code_widths(n: int) -> np.ndarray:
    """Bits of the first ``n`` codes after a clear code: each but the first adds a word to the table, and codes widen one early."""
    size = FIRST + np.maximum(np.arange(n) - 1, 0) + 1
    return 9 + sum((size >= 1 << k).astype(np.int64) for k in (9, 10, 11))


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest first, widening one code early.

    Widths depend on places only, so all codes up to the next clear code are cut out of the
    bytes at once.
    """
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    words32 = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    out: list[bytes] = []
    at, end, ahead = 0, 8 * len(data), 4096
    while at < end:
        widths = _code_widths(min(ahead, (end - at) // 9 + 1))
        places = at + np.cumsum(widths) - widths
        widths = widths[places + widths <= end]
        places = places[: len(widths)]
        codes = (words32[places >> 3] >> (32 - widths - (places & 7)).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)
        marks = np.flatnonzero((codes == CLEAR) | (codes == END))
        if not len(marks) and len(codes) == ahead:
            ahead *= 2  # a table that isn't cleared when it is full
            continue
        stop = int(marks[0]) if len(marks) else len(codes)
        table, before = list(single), b""
        for code in codes[:stop].tolist():
            word = table[code] if code < len(table) else before + before[:1]
            out.append(word)
            if before:
                table.append(before + word[:1])
            before = word
        if stop == len(codes) or codes[stop] == END:
            break
        at = int(places[stop] + widths[stop])
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, hold, held, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal hold, held
        hold, held = (hold << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append(hold >> held)
            hold &= (1 << held) - 1

    put(CLEAR)
    table = {bytes([i]): i for i in range(256)}
    free, word = FIRST, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = free
        free += 1
        word = data[i : i + 1]
        width = max(9, free.bit_length())
        if free == 4094:
            put(CLEAR)
            table, free, width = {bytes([i]): i for i in range(256)}, FIRST, 9
    if word:
        put(table[word])
        free += 1
        width = min(12, max(9, free.bit_length()))
    put(END)
    if held:
        out.append((hold << (8 - held)) & 255)
    return bytes(out)


def pack_bits_decode(data: bytes) -> bytes:
    """Runs: a length byte n below 128 and n + 1 bytes as they are, or one above 128 and a byte that comes 257 - n times."""
    out, i = [], 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += n + 2
        else:
            if n > 128:
                out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2 if n > 128 else 1
    return b"".join(out)


def pack_bits_encode(data: bytes) -> bytes:
    values = np.frombuffer(data, np.uint8)
    cuts = np.flatnonzero(np.diff(values)) + 1
    out, held = bytearray(), bytearray()

    def put_held() -> None:
        for i in range(0, len(held), 128):
            some = held[i : i + 128]
            out.append(len(some) - 1)
            out.extend(some)
        held.clear()

    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]):
        if b - a < 3:
            held.extend(data[a:b])
            continue
        put_held()
        for i in range(a, b, 128):
            n = min(128, b - i)
            out.extend((257 - n, data[a]) if n > 1 else (0, data[a]))
    put_held()
    return bytes(out)


#: How bytes of a strip or tile are packed, by the format's number, and back.
DECODERS = {PLAIN: lambda x: x, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACK_BITS: pack_bits_decode}
ENCODERS = {"plain": (PLAIN, lambda x: x), "lzw": (LZW, lzw_encode), "deflate": (DEFLATE, zlib.compress), "packbits": (PACK_BITS, pack_bits_encode)}


def restored(raw: bytes, height: int, width: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """The values of a strip or tile whose rows were stored as differences, or as they are."""
    if len(raw) < height * width * kind.itemsize:
        raise ValueError("truncated TIFF file")
    if predictor == FLOAT_DIFFERENCES:
        # a row's bytes, the highest of all values first, each less the one before
        rows = np.cumsum(np.frombuffer(raw, np.uint8, height * width * kind.itemsize).reshape(height, -1), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(rows.reshape(height, kind.itemsize, width).transpose(0, 2, 1)).view(kind.newbyteorder(">"))[..., 0].astype(kind.newbyteorder("="))
    values = np.frombuffer(raw, kind, height * width).reshape(height, width).astype(kind.newbyteorder("="))
    if predictor == DIFFERENCES:
        whole = np.dtype(f"u{kind.itemsize}")
        return np.cumsum(values.view(whole), axis=1, dtype=whole).view(values.dtype)
    return values


def differences(values: np.ndarray, kind: np.dtype, predictor: int) -> bytes:
    """The bytes that `restored` takes."""
    if predictor == FLOAT_DIFFERENCES:
        planes = values.astype(kind.newbyteorder(">")).view(np.uint8).reshape(*values.shape, kind.itemsize).transpose(0, 2, 1).reshape(len(values), -1)
        return np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    if predictor == DIFFERENCES:
        whole = np.ascontiguousarray(values).view(f"u{kind.itemsize}")
        values = np.concatenate([whole[:, :1], whole[:, 1:] - whole[:, :-1]], axis=1).view(values.dtype)
    return np.ascontiguousarray(values.astype(kind)).tobytes()


def _directories(data: bytes) -> tuple[str, list[dict[int, tuple[int, ...]]]]:
    """(byte order, tags of each image) along the chain of a file's directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF file")
    (version,) = struct.unpack(order + "H", data[2:4])
    if version != 42:
        raise ValueError("unsupported TIFF layout: 64-bit offsets" if version == 43 else "not a TIFF file")
    (at,) = struct.unpack(order + "I", data[4:8])
    found, seen = [], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("a broken chain of TIFF directories")
        seen.add(at)
        (n,) = struct.unpack(order + "H", data[at : at + 2])
        tags: dict[int, tuple[int, ...]] = {}
        for i in range(n):
            tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
            if kind in FIELDS:
                letter, size = FIELDS[kind]
                place = at + 10 + 12 * i
                if size * count > 4:
                    (place,) = struct.unpack(order + "I", data[place : place + 4])
                tags[tag] = struct.unpack(f"{order}{count}{letter}", data[place : place + size * count])
        found.append(tags)
        (at,) = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])
    if not found:
        raise ValueError("a TIFF file without an image")
    return order, found


def _image(data: bytes, order: str, tags: dict[int, tuple[int, ...]]) -> np.ndarray:
    """The pixels of one image of a file."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    height, width, bits, packing, predictor, kind = (one(tag, n) for tag, n in ((HEIGHT, 0), (WIDTH, 0), (BITS, 1), (COMPRESSION, PLAIN), (PREDICTOR, NO_PREDICTOR), (KIND, 1)))
    other = {
        f"{one(SAMPLES, 1)} samples a pixel": one(SAMPLES, 1) != 1, f"{bits} bits": bits not in (8, 16, 32, 64), f"compression {packing}": packing not in DECODERS,
        f"predictor {predictor}": predictor not in (NO_PREDICTOR, DIFFERENCES, FLOAT_DIFFERENCES), f"sample format {kind}": kind not in KINDS or (kind == 3 and bits == 8),
        "bits from the lowest": one(FILL_ORDER, 1) != 1, "no strips or tiles": STRIPS not in tags and TILES not in tags, "no pixels": height * width == 0,
        "byte differences of whole numbers": predictor == FLOAT_DIFFERENCES and kind != 3,
    }
    for what, holds in other.items():
        if holds:
            raise ValueError(f"unsupported TIFF layout: {what}")
    dtype = np.dtype(f"{order}{KINDS[kind]}{bits // 8}")
    out = np.zeros((height, width), dtype.newbyteorder("="))
    tiled = TILES in tags
    down, across = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS, height), height), width)
    if not down or not across:
        raise ValueError("unsupported TIFF layout: strips or tiles without a size")
    pieces = list(zip(tags[TILES if tiled else STRIPS], tags[TILE_COUNTS if tiled else COUNTS]))
    places = [(r, c) for r in range(0, height, down) for c in range(0, width, across)]
    if len(pieces) < len(places):
        raise ValueError("truncated TIFF file")
    for (r, c), (start, size) in zip(places, pieces):
        if start + size > len(data):
            raise ValueError("truncated TIFF file")
        rows = down if tiled else min(down, height - r)
        piece = restored(DECODERS[packing](data[start : start + size]), rows, across, dtype, predictor)
        out[r : r + down, c : c + across] = piece[: height - r, : width - c]
    return out


def decode_pages(data: bytes) -> list[np.ndarray]:
    """All images of a TIFF file, each a (height, width) array of its own type."""
    order, chain = _directories(data)
    return [_image(data, order, tags) for tags in chain]


def decode(data: bytes) -> np.ndarray:
    """The first image of a TIFF file."""
    order, chain = _directories(data)
    return _image(data, order, chain[0])


def encode_pages(arrays: Sequence[np.ndarray], compression: str = "deflate", predictor: int = NO_PREDICTOR, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF file of one image an array: strips of some 64 KiB, or tiles of (height, width)."""
    out, links = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0" * 4), [4]
    number, pack = ENCODERS[compression]
    for array in arrays:
        if not isinstance(array, np.ndarray) or array.ndim != 2 or not array.size:
            raise ValueError("a non-empty two-dimensional array is needed")
        if array.dtype.kind not in "uif" or array.dtype.itemsize > 8 or array.dtype == np.float16:
            raise ValueError(f"unsupported pixel type {array.dtype}")
        if predictor == FLOAT_DIFFERENCES and array.dtype.kind != "f":
            raise ValueError("differences of a float's bytes need floats")
        kind, (height, width) = array.dtype.newbyteorder(order), array.shape
        down, across = tile or (min(height, max(1, 65536 // (width * kind.itemsize))), width)
        starts, sizes = [], []
        for r in range(0, height, down):
            for c in range(0, width, across):
                piece = array[r : r + down, c : c + across]
                if tile:
                    piece = np.pad(piece, ((0, down - piece.shape[0]), (0, across - piece.shape[1])))
                body = pack(differences(piece, kind, predictor))
                starts.append(len(out))
                sizes.append(len(body))
                out += body
        pieces = {TILE_WIDTH: (4, [across]), TILE_HEIGHT: (4, [down]), TILES: (4, starts), TILE_COUNTS: (4, sizes)} if tile else {STRIPS: (4, starts), ROWS: (4, [down]), COUNTS: (4, sizes)}
        code = {v: k for k, v in KINDS.items()}[array.dtype.kind]
        entries = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8 * kind.itemsize]), COMPRESSION: (3, [number]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), PREDICTOR: (3, [predictor]), KIND: (3, [code])} | pieces
        out += b"\0" * (len(out) % 2)
        out[links[-1] : links[-1] + 4] = struct.pack(order + "I", len(out))
        beyond, fields, tail = len(out) + 2 + 12 * len(entries) + 4, bytearray(struct.pack(order + "H", len(entries))), bytearray()
        for tag, (field, values) in sorted(entries.items()):
            packed = struct.pack(f"{order}{len(values)}{FIELDS[field][0]}", *values)
            fields += struct.pack(order + "HHI", tag, field, len(values))
            fields += packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack(order + "I", beyond + len(tail))
            tail += packed if len(packed) > 4 else b""
        links.append(len(out) + len(fields))
        out += fields + b"\0" * 4 + tail
    if len(links) == 1:
        raise ValueError("a TIFF file has one image at least")
    return bytes(out)


def encode(array: np.ndarray, compress: bool = True) -> bytes:
    """A little-endian TIFF file of one image, LZW or plain."""
    return encode_pages([array], "lzw" if compress else "plain")


READ = "height int, width int, dtype string, pixels array<double>, error string, page int, path string"


def _decoded(pdf: pd.DataFrame, pages: bool = False) -> pd.DataFrame:
    rows = []
    for path, content in zip(pdf["path"], pdf["content"]):
        try:
            images = decode_pages(bytes(content)) if pages else [decode(bytes(content))]
            rows += [(*a.shape, str(a.dtype), a.astype(np.float64).ravel(), None, i, path) for i, a in enumerate(images)]
        except Exception as e:  # any broken file is a failed row, not a failed job
            rows.append((None, None, None, None, f"{type(e).__name__}: {e}", 0, path))
    made = pd.DataFrame(rows, columns=[f.split()[0] for f in READ.split(", ")])
    made[["height", "width"]] = made[["height", "width"]].astype("Int32")
    return made


def read_frames(spark: SparkSession, path: str | list[str], only: DataFrame | None = None, pages: bool = False) -> DataFrame:
    """frames of all .tif and .tiff files of a folder (or of the given files).

    frame_id is a hash of the path. A file that can't be decoded has an error and no pixels.
    ``only`` (path) names the files to decode, all if it isn't given. With ``pages`` each
    image of a file is a frame, with its ``page`` from 0, which the hash includes then.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(path)
    if only is not None:
        files = files.join(only.select("path").distinct(), "path", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 8):  # a few frames at a time
                yield _decoded(pdf.iloc[i : i + 8], pages)

    frames = files.select("path", "content").mapInPandas(run, READ)
    name, more = base_name(F.col("path")), ["page"] if pages else []
    return frames.select(F.xxhash64("path", *more).alias("frame_id"), "path", name.alias("filename"), scan_value(name).alias("xps_value"), "height", "width", "dtype", "pixels", "error", *more)


def write_frames(frames: DataFrame, path: str, dtype: str = "float64", compression: str = "deflate") -> int:
    """Each frame as ``filename``.tiff in the folder ``path``, written by its task; returns the number of files.

    ``compression`` is plain, lzw, deflate or packbits. Missing pixels are NaN, which integer
    types don't have: they are an error then. All files appear or none, and two frames of one
    name are an error (see `write_files`).
    """

    def content(row) -> bytes:
        values = np.array([np.nan if v is None else v for v in row.pixels], dtype=float)
        kind = np.dtype(dtype)
        if kind.kind != "f" and np.isnan(values).any():
            raise ValueError(f"{row.filename} has missing pixels, which {dtype} can't hold")
        return encode_pages([values.reshape(row.height, row.width).astype(kind)], compression)

    rows = frames.select("height", "width", "pixels", F.concat("filename", F.lit(".tiff")).alias("filename"))
    return write_files(rows, path, "filename", content)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame_id, filename, xps_value) of the TIFF files of a folder, as `read_frames` has them; contents stay unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(path)
    name = base_name(F.col("path"))
    return files.select("path", F.xxhash64("path").alias("frame_id"), name.alias("filename"), scan_value(name).alias("xps_value"))


def failures(frames: DataFrame) -> DataFrame:
    return frames.where("error IS NOT NULL").select("filename", "error")


def read_one(path: str) -> np.ndarray:
    """One file on the driver; without a suffix, .tiff and then .tif are tried."""
    p = Path(path)
    if p.suffix.lower() not in (".tif", ".tiff"):
        p = next((q for q in (p.with_name(p.name + ".tiff"), p.with_name(p.name + ".tif")) if q.exists()), p)
    return decode(p.read_bytes())


def write_one(array: np.ndarray, path: str, compress: bool = True) -> str:
    """One frame from the driver, always as .tiff; a suffix of another kind is replaced."""
    p = Path(path).with_suffix(".tiff")
    data = encode(array, compress)
    try:
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    except OSError as e:
        raise OSError(f"cannot write {p}: {e}") from e
    return str(p)
