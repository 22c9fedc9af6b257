"""Mask images: 8-bit PNG files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlake.sources.files import write_files

# The PNG signature, bytes a pixel by colour type, and weights of red, green, blue in grey.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
GREY = (299, 587, 114)
LEVEL = 128


def decode_png(data: bytes) -> np.ndarray:
    """Grey values (height, width) of an 8-bit PNG without interlacing; colours are weighed."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, header = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    if header is None or header[2] != 8 or header[3] not in CHANNELS or header[6]:
        raise ValueError("unsupported PNG layout")
    width, height, n = header[0], header[1], CHANNELS[header[3]]
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width, n), np.uint8)
    above = np.zeros((width, n), np.int64)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:].reshape(width, n).astype(np.int64)
        if kind == 2:
            line = (line + above) & 255
        elif kind == 1:
            line = np.cumsum(line, axis=0) & 255
        elif kind in (3, 4):
            left, corner = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for x in range(width):
                if kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    a, b, c = abs(p - left), abs(p - above[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                line[x] = (line[x] + guess) & 255
                left, corner = line[x], above[x]
        out[y], above = line, line
    if n >= 3:
        return (out[..., :3].astype(np.int64) @ np.array(GREY) // 1000).astype(np.uint8)
    return out[..., 0]


def write_images(frames: DataFrame, path: str, low: float | None = None, high: float | None = None, colours: Sequence[tuple[int, int, int]] | None = None) -> int:
    """Each frame as ``filename``.png in the folder ``path``, grey or in ``colours``, written by its task; returns the number of files."""

    def content(row) -> bytes:
        values = np.array([np.nan if v is None else v for v in row.pixels], dtype=float)
        return image_of_frame(values.reshape(row.height, row.width), low, high, colours)

    rows = frames.select("height", "width", "pixels", F.concat("filename", F.lit(".png")).alias("filename"))
    return write_files(rows, path, "filename", content)


def encode_png(grey: np.ndarray) -> bytes:
    """An 8-bit grey or RGB PNG file."""
    height, width = grey.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), grey.astype(np.uint8).reshape(height, -1)], axis=1)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0 if grey.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def mask_of_png(data: bytes) -> np.ndarray:
    """1 where the grey value reaches 128, else 0."""
    return (decode_png(data) >= LEVEL).astype(np.int32)


def read_masks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, height, width, mask, error) of all PNG files of a folder; mask is a row-major array of 0 and 1.

    A file that can't be decoded has an error and no mask.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,PNG}").load(path)

    def run(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"]):
                try:
                    mask = mask_of_png(bytes(content))
                    rows.append((name, *mask.shape, mask.ravel(), None))
                except Exception as e:  # any broken file is a failed row, not a failed job
                    rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            made = pd.DataFrame(rows, columns=["path", "height", "width", "mask", "error"])
            yield made.astype({"height": "Int32", "width": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, height int, width int, mask array<int>, error string")


def mask_pixels(masks: DataFrame) -> DataFrame:
    """(path, r, c, keep) of decoded masks."""
    rows = masks.where("error IS NULL").select("path", "width", F.posexplode("mask").alias("p", "keep"))
    return rows.select("path", F.floor(F.col("p") / F.col("width")).cast("int").alias("r"), (F.col("p") % F.col("width")).cast("int").alias("c"), "keep")


def coloured(scaled: np.ndarray, colours: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Red, green and blue of values from 0 to 1, between evenly spaced colours."""
    places = np.linspace(0, 1, len(colours))
    return np.stack([np.interp(scaled, places, [c[k] for c in colours]) for k in range(3)], axis=-1)


def image_of_frame(frame: np.ndarray, low: float | None = None, high: float | None = None, colours: Sequence[tuple[int, int, int]] | None = None) -> bytes:
    """A PNG of a frame clamped to [low, high] (its own range where not given); a constant frame is of the lowest colour.

    Grey from black to white, or in ``colours``, two or more from lowest to highest.
    """
    if frame.ndim != 2:
        raise ValueError("a two-dimensional frame is needed")
    if colours is not None and len(colours) < 2:
        raise ValueError("two colours at least are needed")
    lo, hi = np.nanmin(frame) if low is None else low, np.nanmax(frame) if high is None else high
    scaled = np.zeros(frame.shape) if hi == lo else (np.clip(np.nan_to_num(frame, nan=lo), lo, hi) - lo) / (hi - lo)
    return encode_png(np.rint(scaled * 255 if colours is None else coloured(scaled, colours)))
