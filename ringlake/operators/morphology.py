"""Neighbourhoods of pixels: dilation, connected clusters, blurs."""

from __future__ import annotations

from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlake.functions.geometry import reflect

# Bounds of the cluster size classes.
SIZE_CLASSES = ((1, 1), (2, 3), (4, 6), (7, 10), (11, 20))


def dilated(flag: str) -> Column:
    """True where the flag holds for the pixel or one of its four neighbours; outside the frame it doesn't.

    Neighbours are the rows before and after in a row and in a column of the frame, if they
    are next to it: windows inside a frame, so no shuffle of pixels dealt out by frame.
    """

    def beside(line: str, along: str) -> Column:
        w = Window.partitionBy("frame_id", line).orderBy(along)
        out = F.lit(False)
        for step, move in ((F.lag, -1), (F.lead, 1)):
            out = out | F.coalesce((step(along).over(w) == F.col(along) + move) & step(flag).over(w), F.lit(False))
        return out

    return F.col(flag) | beside("r", "c") | beside("c", "r")


def labelled(frame: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first_r, first_c) of the 4-connected cluster of each hit; hits are in order of frame, row and column.

    Hits side by side in a row are one run. A run takes the least number among itself and the
    runs that it touches in the next row, and numbers are followed to their ends, until none
    changes; many frames at once.
    """
    line = np.concatenate([[0], np.cumsum((frame[1:] != frame[:-1]) | (r[1:] != r[:-1]))])
    joined = (line[1:] == line[:-1]) & (c[1:] == c[:-1] + 1)
    run = np.concatenate([[0], np.cumsum(~joined)])
    heads = np.flatnonzero(np.concatenate([[True], ~joined]))
    # hits right below one another: looked up by (frame, row, column) as one sorted number
    number = np.concatenate([[0], np.cumsum(frame[1:] != frame[:-1])]) * (int(r.max()) + 2) + r
    key = number * (int(c.max()) + 1) + c
    at = np.minimum(np.searchsorted(key, key + int(c.max()) + 1), len(key) - 1)
    below = key[at] == key + int(c.max()) + 1
    pairs = np.unique(np.column_stack([run[below], run[at[below]]]), axis=0)
    least = np.arange(len(heads))
    while True:
        before = least.copy()
        low = np.minimum(least[pairs[:, 0]], least[pairs[:, 1]])
        for side in (0, 1):
            np.minimum.at(least, least[pairs[:, side]], low)
            np.minimum.at(least, pairs[:, side], low)
        least = least[least]
        if (least == before).all():
            break
    first = heads[least[run]]
    return r[first], c[first]


def clusters(hits: DataFrame) -> DataFrame:
    """(frame_id, r, c, first_r, first_c) of 4-connected hits; a cluster is named by its first pixel in row-major order.

    Clusters never span frames: frames are dealt out, and a task labels those of an Arrow
    batch together, the last one with the batch that ends it.
    """
    schema = "frame_id long, r int, c int, first_r int, first_c int"

    def done(table: pa.Table) -> pa.RecordBatch:
        frame, r, c = (table.column(x).to_numpy() for x in ("frame_id", "r", "c"))
        first_r, first_c = labelled(frame, r.astype(np.int64), c.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(frame), pa.array(r), pa.array(c), pa.array(first_r.astype(np.int32)), pa.array(first_c.astype(np.int32))], names=["frame_id", "r", "c", "first_r", "first_c"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column("frame_id").to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))
            if cut or (held and held[0].column("frame_id")[0].as_py() != ids[-1]):
                held.append(batch.slice(0, cut))
                yield done(pa.Table.from_batches([x for x in held if len(x)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield done(pa.Table.from_batches(held))

    rows = hits.select(F.col("frame_id").cast("long").alias("frame_id"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))
    return rows.where("frame_id IS NOT NULL").repartition("frame_id").sortWithinPartitions("frame_id", "r", "c").mapInArrow(run, schema)


def cluster_sizes(members: DataFrame) -> DataFrame:
    """(frame_id, first_r, first_c, size) of each cluster."""
    return members.groupBy("frame_id", "first_r", "first_c").agg(F.count("*").alias("size"))


def size_histogram(sizes: DataFrame) -> DataFrame:
    """(size_class, n_clusters, smallest, largest); clusters above the last class count as `>20`."""
    name = F.lit(f">{SIZE_CLASSES[-1][1]}")
    for a, b in reversed(SIZE_CLASSES):
        name = F.when(F.col("size").between(a, b), str(a) if a == b else f"{a}-{b}").otherwise(name)
    return sizes.groupBy(name.alias("size_class")).agg(F.count("*").alias("n_clusters"), F.min("size").alias("smallest"), F.max("size").alias("largest"))


def removal_summary(flagged: DataFrame) -> DataFrame:
    """Per frame: pixels, removed pixels, their rate in percent of the real frame size, and the range they lie in."""
    gone = F.when(F.col("removed"), 1)
    return flagged.groupBy("frame_id").agg(
        F.count("*").alias("n_pixels"), F.count(gone).alias("n_removed"), (100.0 * F.count(gone) / F.count("*")).alias("rate"),
        *[f(F.when(F.col("removed"), F.col(x))).alias(f"{n}_{x}") for x in ("r", "c") for f, n in ((F.min, "first"), (F.max, "last"))],
    )


def first_removed(flagged: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` removed pixels of each frame in row-major order, with their values."""
    w = Window.partitionBy("frame_id").orderBy("r", "c")
    return flagged.where("removed").withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).select("frame_id", "k", "r", "c", "v")


def _taps(pixels: Column, height: Column, width: Column, weights: list[float], along_rows: bool) -> Column:
    """Weighted sum of neighbours along one axis, for each pixel of a row-major array."""
    half = len(weights) // 2

    def one(p: Column) -> Column:
        r, c = F.floor(p / width), p % width
        terms = []
        for k, w in enumerate(weights):
            at = r * width + reflect(c + (k - half), width) if along_rows else reflect(r + (k - half), height) * width + c
            terms.append(F.element_at(pixels, (at + 1).cast("int")) * w)
        return sum(terms[1:], terms[0])

    return F.transform(F.sequence(F.lit(0), F.size(pixels) - 1), one)


def _separable(frames: DataFrame, weights: list[float]) -> DataFrame:
    h, w = F.col("height"), F.col("width")
    # the array of one element holds the first pass: named by a column, it would be computed again for each tap
    once = F.array(_taps(F.col("pixels"), h, w, weights, True))
    return frames.withColumn("pixels", F.element_at(F.transform(once, lambda half: _taps(half, h, w, weights, False)), 1))


def gaussian_blur(frames: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Frames blurred by a Gaussian cut at 4 sigma, borders reflected. Within each row: no join, no shuffle."""
    half = int(4 * sigma + 0.5)
    kernel = [exp(-0.5 * (i / sigma) ** 2) for i in range(-half, half + 1)]
    return _separable(frames, [k / sum(kernel) for k in kernel])


def box_mean(frames: DataFrame, size: int = 3) -> DataFrame:
    """Frames averaged over a box of odd size, borders reflected. Within each row: no join, no shuffle."""
    if size % 2 == 0:
        raise ValueError("the size of the box must be odd")
    return _separable(frames, [1.0 / size] * size)
