"""Frames cut into blocks of fixed arrays, so that one frame can spread over tasks.

blocks: frame_id, xps_value, br, bc, v (array<double>, row-major, null = missing); block
(br, bc) holds the rows from br * side and the columns from bc * side, ``side`` of each or
what is left of the frame. What needs a pixel's neighbours gets them by an exchange: each
block sends the strips that its neighbours need, and then works alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlake.operators.frames import missing_as_null
from ringlake.operators.graph import components
from ringlake.operators.morphology import labelled
from ringlake.sources.scratch import checkpoint

#: Default side of a block: 32 KB of doubles.
SIDE = 64
KEYS = ["frame_id", "br", "bc"]
MEMBERS = "frame_id long, r int, c int, label long"
BORDERS = "frame_id long, down boolean, line int, pos int, before long, after long"
STRIPS = "frame_id long, br int, bc int, r int, c int, h int, w int, v array<double>"


@dataclass(frozen=True)
class Layout:
    """Shape of the frames and side of their blocks."""

    height: int
    width: int
    side: int = SIDE

    def __post_init__(self) -> None:
        if min(self.height, self.width, self.side) < 1:
            raise ValueError("height, width and side must be 1 or more")

    @property
    def down(self) -> int:
        """Blocks in a column."""
        return -(-self.height // self.side)

    @property
    def across(self) -> int:
        """Blocks in a row."""
        return -(-self.width // self.side)

    def span(self, br: int, bc: int) -> tuple[int, int, int, int]:
        """(first row, end, first column, end) of a block."""
        r, c = br * self.side, bc * self.side
        return r, min(r + self.side, self.height), c, min(c + self.side, self.width)

    def around(self, br: int, bc: int, margin: int) -> tuple[int, int, int, int]:
        """`span` with ``margin`` more pixels on each side, as far as the frame goes."""
        r, r_end, c, c_end = self.span(br, bc)
        return max(r - margin, 0), min(r_end + margin, self.height), max(c - margin, 0), min(c_end + margin, self.width)


def to_blocks(frames: DataFrame, at: Layout) -> DataFrame:
    """The blocks of frames of the layout's shape, cut out of each frame's array at once."""
    b = lambda i: (F.floor(i / at.across), i % at.across)

    def one(i):
        br, bc = b(i)
        top, left = br * at.side, bc * at.side
        rows = F.sequence(top, F.least(top + at.side, F.lit(at.height)) - 1)
        wide = F.least(F.lit(at.side), F.lit(at.width) - left)
        v = F.flatten(F.transform(rows, lambda r: F.slice("pixels", (r * at.width + left + 1).cast("int"), wide.cast("int"))))
        return F.struct(br.cast("int").alias("br"), bc.cast("int").alias("bc"), v.alias("v"))

    cut = F.transform(F.sequence(F.lit(0), F.lit(at.down * at.across - 1)), one)
    whole = F.when(F.size("pixels") == at.height * at.width, cut).otherwise(F.raise_error(F.concat(F.lit(f"not {at.height} x {at.width} pixels: frame "), F.col("frame_id").cast("string"))).cast("array<struct<br:int,bc:int,v:array<double>>>"))
    return missing_as_null(frames).select("frame_id", "xps_value", F.explode(whole).alias("b")).select("frame_id", "xps_value", "b.*")


def from_blocks(blocks: DataFrame, at: Layout, sums: Sequence[str] = ()) -> DataFrame:
    """The inverse of to_blocks: (frame_id, xps_value, height, width, pixels, and ``sums`` over its blocks); a frame without all of its blocks is an error."""
    held = blocks.groupBy("frame_id", "xps_value").agg(F.array_sort(F.collect_list(F.struct("br", "bc", "v"))).alias("s"), *[F.sum(c).alias(c) for c in sums])

    def row(r):
        def piece(bc):
            wide = F.least(F.lit(at.side), F.lit(at.width) - bc * at.side)
            return F.slice(F.get("s", (F.floor(r / at.side) * at.across + bc).cast("int"))["v"], ((r % at.side) * wide + 1).cast("int"), wide.cast("int"))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(at.across - 1)), piece))

    lines = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(at.height - 1)), row))
    missing = F.raise_error(F.concat(F.lit("blocks are missing: frame "), F.col("frame_id").cast("string"))).cast("array<double>")
    whole = F.when(F.size("s") == at.down * at.across, lines).otherwise(missing)
    return held.select("frame_id", "xps_value", F.lit(at.height).alias("height"), F.lit(at.width).alias("width"), whole.alias("pixels"), *sums)


def table_blocks(pixels: DataFrame, columns: Sequence[str], at: Layout, group: Sequence[str] = ()) -> DataFrame:
    """(group, br, bc, columns as arrays) of a table with a row for each pixel of a frame, or of one frame a group."""
    place = [F.floor(F.col(x) / at.side).cast("int").alias(f"b{x}") for x in ("r", "c")]
    values = F.array_sort(F.collect_list(F.struct("r", "c", *[F.col(c).cast("double").alias(c) for c in columns])))
    held = pixels.groupBy(*group, *place).agg(values.alias("s"))
    return held.select(*group, "br", "bc", *[F.col("s")[c].alias(c) for c in columns])


class Batch:
    """Blocks of an Arrow batch, by row: a matrix of each array column, missing values as NaN."""

    def __init__(self, batch: pa.RecordBatch, at: Layout, columns: Sequence[str]):
        self.batch, self.at = batch, at
        self.place = list(zip(batch.column("br").to_pylist(), batch.column("bc").to_pylist()))
        self.spans = [at.span(*p) for p in self.place]
        self.values = {}
        for c in columns:
            lists = batch.column(c)
            self.values[c] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])

    def __len__(self) -> int:
        return len(self.place)

    def block(self, i: int, column: str) -> np.ndarray:
        values, ends = self.values[column]
        r, r_end, c, c_end = self.spans[i]
        own = values[ends[i] : ends[i + 1]]
        return own.reshape(r_end - r, c_end - c) if len(own) else np.full((r_end - r, c_end - c), np.nan)

    def padded(self, column: str, margin: int) -> Iterator[tuple[np.ndarray, tuple[int, int, int, int]]]:
        """Each block with the strips that its neighbours sent (column ``halo``), and the rows and columns that this spans."""
        lists = self.batch.column("halo")
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
        strips = lists.flatten()
        r, c, h, w = (strips.field(x).to_pylist() for x in ("r", "c", "h", "w"))
        inner = strips.field("v")
        values, cuts = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(inner.value_lengths().to_numpy())])
        for i, place in enumerate(self.place):
            top, end, left, right = self.at.around(*place, margin)
            out = np.full((end - top, right - left), np.nan)
            y, y_end, x, x_end = self.spans[i]
            out[y - top : y_end - top, x - left : x_end - left] = self.block(i, column)
            for k in range(ends[i], ends[i + 1]):
                out[r[k] - top : r[k] - top + h[k], c[k] - left : c[k] - left + w[k]] = values[cuts[k] : cuts[k + 1]].reshape(h[k], w[k])
            yield out, (top, end, left, right)


def lists_of(arrays: Sequence[np.ndarray]) -> pa.ListArray:
    """A list for each array; NaN is null."""
    flat = np.concatenate([np.zeros(0), *(a.ravel() for a in arrays)])
    offsets = np.concatenate([[0], np.cumsum([a.size for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, from_pandas=True))


def exchange(blocks: DataFrame, column: str, margin: int, at: Layout) -> DataFrame:
    """The blocks with ``halo``: the strips of ``column`` within ``margin`` pixels of each, sent by the blocks around it.

    A block sends strips only, whatever its size; strips and blocks meet by (frame_id, br, bc).
    """
    reach = -(-margin // at.side)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows, values = Batch(batch, at, (column,)), [], []
            frame = batch.column("frame_id").to_pylist()
            for i, (br, bc) in enumerate(own.place):
                r, r_end, c, c_end = own.spans[i]
                v = own.block(i, column)
                for y in range(max(br - reach, 0), min(br + reach, at.down - 1) + 1):
                    for x in range(max(bc - reach, 0), min(bc + reach, at.across - 1) + 1):
                        top, end, left, right = at.around(y, x, margin)
                        a, b, p, q = max(top, r), min(end, r_end), max(left, c), min(right, c_end)
                        if (y, x) != (br, bc) and a < b and p < q:
                            rows.append((frame[i], y, x, a, p, b - a, q - p))
                            values.append(v[a - r : b - r, p - c : q - c])
            columns = [pa.array([row[k] for row in rows], pa.int64() if k == 0 else pa.int32()) for k in range(7)]
            yield pa.RecordBatch.from_arrays([*columns, lists_of(values)], names=[f.split()[0] for f in STRIPS.split(", ")])

    strips = blocks.select(*KEYS, column).mapInArrow(cut, STRIPS)
    sent = strips.groupBy(*KEYS).agg(F.collect_list(F.struct("r", "c", "h", "w", "v")).alias("halo"))
    return blocks.join(sent, KEYS, "left")


def _with_column(blocks: DataFrame, name: str, work: Callable[[pa.RecordBatch], Sequence[np.ndarray]]) -> DataFrame:
    """The blocks with the array column ``name`` that ``work`` makes of each batch, and without ``halo``."""
    kept = [c for c in blocks.columns if c not in ("halo", name)]
    schema = ", ".join(f"`{c}` {t}" for c, t in blocks.dtypes if c in kept) + f", `{name}` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists_of(work(batch))], names=[*kept, name])

    return blocks.mapInArrow(run, schema)


def spread(hit: np.ndarray) -> np.ndarray:
    """True where the flag holds for a pixel or one of its four neighbours."""
    near = hit.copy()
    near[1:] |= hit[:-1]
    near[:-1] |= hit[1:]
    near[:, 1:] |= hit[:, :-1]
    near[:, :-1] |= hit[:, 1:]
    return near


def dilated_blocks(blocks: DataFrame, at: Layout, flag: str = "hit", name: str = "near") -> DataFrame:
    """The blocks with ``name``: 1 where ``flag`` is 1 for the pixel or one of its four neighbours, in this block or the next, else 0."""

    def work(batch: pa.RecordBatch) -> list[np.ndarray]:
        own = Batch(batch, at, (flag,))
        out = []
        for (wide, (top, _, left, _)), (r, r_end, c, c_end) in zip(own.padded(flag, 1), own.spans):
            out.append(spread(wide == 1)[r - top : r_end - top, c - left : c_end - left].astype(float))
        return out

    return _with_column(exchange(blocks, flag, 1, at), name, work)


def marked_blocks(blocks: DataFrame, at: Layout, sigma: float, ratio: float) -> DataFrame:
    """The blocks (v, bg, med, mad) with v less bg, ``hit`` where it is above med + sigma mad, and ``low`` where it is above med + sigma ratio mad; 1 or 0."""
    names = ["frame_id", "xps_value", "br", "bc", "v", "hit", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, made = Batch(batch, at, ("v", "bg", "med", "mad")), []
            for i in range(len(own)):
                v, med, mad = own.block(i, "v") - own.block(i, "bg"), own.block(i, "med"), own.block(i, "mad")
                made.append((v, (v > med + sigma * mad).astype(float), (v > med + sigma * ratio * mad).astype(float)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:4]], *[lists_of([m[k] for m in made]) for k in range(3)]], names=names)

    return blocks.select(*names[:4], "v", "bg", "med", "mad").mapInArrow(run, "frame_id long, xps_value double, br int, bc int, v array<double>, hit array<double>, low array<double>")


def rejected_blocks(marked: DataFrame, masks: DataFrame, at: Layout) -> DataFrame:
    """(frame_id, xps_value, br, bc, v, drift_sum, drift_n): hits, and those of their neighbours that are ``low``, are missing.

    The sums are of the block's known pixels where the blocks of ``masks`` (br, bc, bkg), one
    frame in size, are 0: what a frame's drift is made of.
    """
    names = ["frame_id", "xps_value", "br", "bc", "v", "drift_sum", "drift_n"]
    known = dilated_blocks(marked, at).join(F.broadcast(masks.select("br", "bc", "bkg")), ["br", "bc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, made = Batch(batch, at, ("v", "low", "near", "bkg")), []
            for i in range(len(own)):
                v = np.where((own.block(i, "near") == 1) & (own.block(i, "low") == 1), np.nan, own.block(i, "v"))
                sample = v[(own.block(i, "bkg") == 0) & ~np.isnan(v)]
                made.append((v, float(sample.sum()), len(sample)))
            columns = [lists_of([m[0] for m in made]), pa.array([m[1] for m in made], pa.float64()), pa.array([m[2] for m in made], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:4]], *columns], names=names)

    return known.select(*names[:4], "v", "low", "near", "bkg").mapInArrow(run, "frame_id long, xps_value double, br int, bc int, v array<double>, drift_sum double, drift_n long")


def _mirrored(first: int, end: int, size: int) -> np.ndarray:
    """Indices first to end - 1 reflected at the borders of 0..size-1, the edge pixel repeated."""
    m = np.arange(first, end) % (2 * size)
    return np.where(m < size, m, 2 * size - 1 - m)


def blurred_blocks(blocks: DataFrame, weights: Sequence[float], at: Layout, column: str = "v") -> DataFrame:
    """The blocks with ``column`` weighed over an odd number of neighbours along rows, then along columns; the frame's borders are reflected.

    A missing pixel makes all missing that it counts for.
    """
    if len(weights) % 2 == 0:
        raise ValueError("an odd number of weights is needed")
    half, taps = len(weights) // 2, np.asarray(weights, dtype=float)

    def work(batch: pa.RecordBatch) -> list[np.ndarray]:
        own = Batch(batch, at, (column,))
        out = []
        for (wide, (top, _, left, _)), (r, r_end, c, c_end) in zip(own.padded(column, half), own.spans):
            rows, columns = _mirrored(r - half, r_end + half, at.height) - top, _mirrored(c - half, c_end + half, at.width) - left
            v = wide[np.ix_(rows, columns)]
            along = sum(w * v[:, k : k + c_end - c] for k, w in enumerate(taps))
            out.append(sum(w * along[k : k + r_end - r] for k, w in enumerate(taps)))
        return out

    return _with_column(exchange(blocks, column, half, at), column, work)


def gaussian_blocks(blocks: DataFrame, at: Layout, sigma: float = 1.0) -> DataFrame:
    """Blurred by a Gaussian cut at 4 sigma."""
    half = int(4 * sigma + 0.5)
    kernel = [exp(-0.5 * (i / sigma) ** 2) for i in range(-half, half + 1)]
    return blurred_blocks(blocks, [k / sum(kernel) for k in kernel], at)


def box_blocks(blocks: DataFrame, at: Layout, size: int = 3) -> DataFrame:
    """Averaged over a box of odd size."""
    return blurred_blocks(blocks, [1.0 / size] * size, at)


def cluster_blocks(blocks: DataFrame, at: Layout, flag: str = "hit") -> DataFrame:
    """(frame_id, r, c, first_r, first_c) of the pixels whose ``flag`` is 1: the first pixel, in row-major order, of each one's 4-connected cluster.

    Clusters are labelled inside blocks. Pixels side by side on both sides of a border join
    the labels of their blocks; what such joins connect is one cluster, and takes its least
    label. So a cluster may wind through any number of blocks, in any number of tasks.
    """
    width = at.width

    def hits(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """(block, row, column, label) of the hits of a batch, by block, row and column."""
        own = Batch(batch, at, (flag,))
        found = [np.argwhere(own.block(i, flag) == 1) + np.array(own.spans[i])[[0, 2]] for i in range(len(own))]
        which = np.repeat(np.arange(len(own)), [len(x) for x in found])
        r, c = np.concatenate([np.zeros((0, 2), dtype=np.int64), *found]).astype(np.int64).T
        if not len(which):
            return which, r, c, r
        first_r, first_c = labelled(which, r, c)
        return which, r, c, first_r * width + first_c

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, r, c, label = hits(batch)
            frame = batch.column("frame_id").take(pa.array(which))
            yield pa.RecordBatch.from_arrays([frame, pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(label)], names=[f.split()[0] for f in MEMBERS.split(", ")])

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, r, c, label = hits(batch)
            frame = batch.column("frame_id")
            for down, along, across, size in ((True, c, r, at.height), (False, r, c, at.width)):
                ends = (across % at.side == at.side - 1) & (across < size - 1)
                starts = (across % at.side == 0) & (across > 0)
                for at_end, mine in ((True, ends), (False, starts)):
                    n = int(mine.sum())
                    nothing = pa.nulls(n, pa.int64())
                    known = pa.array(label[mine])
                    line = (across[mine] + (1 if at_end else 0)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [frame.take(pa.array(which[mine])), pa.array(np.full(n, down)), pa.array(line), pa.array(along[mine].astype(np.int32)), known if at_end else nothing, nothing if at_end else known],
                        names=[f.split()[0] for f in BORDERS.split(", ")],
                    )

    rows = blocks.select(*KEYS, flag)
    members = checkpoint(rows.mapInArrow(inside, MEMBERS))
    met = rows.mapInArrow(borders, BORDERS).groupBy("frame_id", "down", "line", "pos").agg(F.max("before").alias("a"), F.max("after").alias("b"))
    roots = components(met.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("frame_id").alias("g"), "a", "b"))
    named = members.join(roots.select(F.col("g").alias("frame_id"), F.col("node").alias("label"), "root"), ["frame_id", "label"], "left")
    first = F.coalesce("root", "label")
    return named.select("frame_id", "r", "c", F.floor(first / width).cast("int").alias("first_r"), (first % width).cast("int").alias("first_c"))
