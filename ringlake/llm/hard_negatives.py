"""Hard negatives: product-quantised scores with residual bounds choose candidates, whole-number products decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlake.llm.common import checkpoint
from ringlake.llm.vector_codes import Codebooks, bytes_rows, first_width, selected, train, whole_vectors

SCALE = 256
#: Rounds that codebooks are refined by; more make bounds a little narrower.
ROUNDS = 2
#: Most parts of a code: a byte each.
PARTS = 16
#: Anchors that go out at once; with their lists they bound a task's memory.
BLOCK = 16_384

INDEX = "vec_id long, label long, vector binary, codes binary, residual long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def parts_of(width: int) -> int:
    """The most parts, up to PARTS, that ``width`` components fall into evenly."""
    return max(p for p in range(1, PARTS + 1) if width % p == 0)


def index_vectors(rows: DataFrame, books: Codebooks) -> DataFrame:
    """INDEX of every row: whole numbers, a code byte a part, and the squared norm of what the code leaves over."""
    width, each, shared = books.width, books.width // len(books.tables), rows.sparkSession.sparkContext.broadcast(books.trees())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, numbers = whole_vectors(batch.column("embedding"), width, books.scale)
            found = [tree.nearest(numbers[:, p * each : (p + 1) * each]) for p, tree in enumerate(shared.value)]
            residual = np.sum([d for _, d in found], axis=0, dtype=np.int64)
            columns = [batch.column(c).take(pa.array(kept)) for c in ("vec_id", "label")]
            codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*columns, bytes_rows(numbers.astype(np.int32)), bytes_rows(codes), pa.array(residual)], names=["vec_id", "label", "vector", "codes", "residual"])

    return rows.mapInArrow(run, INDEX)


def matrix_of(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """The rows of a binary column, all of one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, width), dtype=kind)
    start = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], kind, len(column) * width, start).reshape(-1, width)


class Batch:
    """Rows of the index in order of their labels, to be scored against one anchor after the other."""

    def __init__(self, batch: pa.RecordBatch, books: Codebooks):
        label = batch.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        self.label, self.ids = label[order], batch.column("vec_id").to_numpy()[order]
        self.numbers = matrix_of(batch.column("vector"), np.int32, books.width)[order].astype(np.int64)
        parts = len(books.tables)
        size = len(books.tables[0])
        self.cells = matrix_of(batch.column("codes"), np.uint8, parts)[order].astype(np.int64).T + np.arange(parts)[:, None] * size
        # rounded up, as a bound must be
        self.norms = np.sqrt(batch.column("residual").to_numpy()[order].astype(float)) * (1 + 1e-12)

    def own(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]))

    def bounds(self, table: np.ndarray, norm: float, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) that the scores of the rows can be: the sum of their parts' table entries, and by how much residuals can change it."""
        score = reduce(np.add, (table[c[rows]] for c in self.cells))
        reach = np.ceil(norm * self.norms[rows] * (1 + 1e-12)).astype(np.int64) + 1
        return score - reach, score + reach


class Anchors:
    """A block of anchors: ids, labels, whole numbers; and for each the table of its products with all entries."""

    def __init__(self, table: pa.Table, books: Codebooks):
        self.ids, self.labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        self.numbers = matrix_of(table.column("vector"), np.int32, books.width).astype(np.int64)
        self.norms = np.sqrt((self.numbers.astype(float) ** 2).sum(axis=1)) * (1 + 1e-12)
        self.entries = np.stack(books.tables)

    def table(self, a: int) -> np.ndarray:
        parts = self.numbers[a].reshape(len(self.entries), 1, -1)
        return (self.entries * parts).sum(axis=2).ravel()


def first_of(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:n]


class Best:
    """The first ``n`` rows so far, in order of score and id."""

    def __init__(self, n: int):
        self.n, self.scores, self.ids = n, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def need(self, least: int) -> int:
        """The score that a row must reach to matter."""
        return max(least, int(self.scores[-1])) if len(self.scores) == self.n else least

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            k = first_of(scores, ids, self.n)
            self.scores, self.ids = scores[k], ids[k]


def sure(least: np.ndarray, n: int, low: int) -> int:
    """``n`` rows reach at least this score: the n-th highest of their lower bounds, or ``low`` if there are fewer."""
    return max(low, int(np.partition(least, len(least) - n)[len(least) - n])) if len(least) >= n else low


LOWEST = -(1 << 62)


def add_positives(batch: Batch, anchors: Anchors, best: list[Best], n: int) -> None:
    """Meet one batch: the first ``n`` rows of each anchor's label, but for those of its own id."""
    for a, kept in enumerate(best):
        rows = batch.own(int(anchors.labels[a]))
        if rows.start == rows.stop:
            continue
        least, most = batch.bounds(anchors.table(a), anchors.norms[a], rows)
        other = batch.ids[rows] != anchors.ids[a]
        need = sure(least[other], n, kept.need(LOWEST))
        at = np.flatnonzero(other & (most >= need)) + rows.start
        kept.add(batch.numbers[at] @ anchors.numbers[a], batch.ids[at])


def add_negatives(batch: Batch, anchors: Anchors, windows: dict[int, dict[int, tuple[int, int, Best]]], n: int) -> None:
    """Meet one batch: of each window (low, high) of an anchor the first ``n`` rows of other labels whose score is in it.

    Rows whose bounds can't reach any window, or not what the window's first rows already
    have, are left out; the product of whole numbers decides on the others.
    """
    for a, own in windows.items():
        rows = batch.own(int(anchors.labels[a]))
        least, most = batch.bounds(anchors.table(a), anchors.norms[a], slice(None))
        other = (least <= max(high for _, high, _ in own.values())) & (most >= min(kept.need(low) for low, _, kept in own.values()))
        other[rows] = False
        at = np.flatnonzero(other)
        least, most = least[at], most[at]
        wanted = np.zeros(len(at), dtype=bool)
        for low, high, kept in own.values():
            need = sure(least[(least >= low) & (most <= high)], n, kept.need(low))
            wanted |= (most >= need) & (least <= high)
        at = at[wanted]
        scores, ids = batch.numbers[at] @ anchors.numbers[a], batch.ids[at]
        for low, high, kept in own.values():
            hit = (scores >= kept.need(low)) & (scores <= high)
            kept.add(scores[hit], ids[hit])


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole number s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def _block(index: DataFrame, anchors: pa.Table, books: Codebooks, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """RESULT of one block of anchors; two passes over the index."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast((Anchors(anchors, books), books))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables = shared.value
        best = [Best(positives) for _ in own.ids]
        for batch in batches:
            add_positives(Batch(batch, tables), own, best, positives)
        yield _rows([(a, 0, kept) for a, kept in enumerate(best)], "a int, of long, score long, id long")

    schema = "a int, of long, score long, id long"
    by_anchor = Window.partitionBy("a").orderBy(F.desc("score"), "id")
    found = index.mapInArrow(near, schema).withColumn("k", F.row_number().over(by_anchor)).where(F.col("k") <= positives)
    found = checkpoint(found.select("a", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    pairs = spark.sparkContext.broadcast(found.select("a", "positive_score").distinct().toArrow().to_pylist())

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables = shared.value
        windows: dict[int, dict[int, tuple[int, int, Best]]] = {}
        for pair in pairs.value:
            least, most = window_of(pair["positive_score"], low, high)
            if least <= most:
                windows.setdefault(pair["a"], {})[pair["positive_score"]] = least, most, Best(negatives)
        for batch in batches:
            add_negatives(Batch(batch, tables), own, windows, negatives)
        yield _rows([(a, of, kept) for a, w in windows.items() for of, (_, _, kept) in w.items()], schema)

    by_pair = Window.partitionBy("a", "of").orderBy(F.desc("score"), "id")
    ranked = index.mapInArrow(hard, schema).withColumn("rank", F.row_number().over(by_pair)).where(F.col("rank") <= negatives)
    named = spark.createDataFrame(pa.table({"a": pa.array(np.arange(anchors.num_rows, dtype=np.int32)), "anchor_id": anchors.column("vec_id")}))
    out = found.join(named, "a").join(ranked.withColumnRenamed("a", "a2"), (F.col("a") == F.col("a2")) & (F.col("positive_score") == F.col("of")))
    return checkpoint(out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def _rows(lists: list[tuple[int, int, Best]], schema: str) -> pa.RecordBatch:
    sizes = [len(kept.scores) for _, _, kept in lists]
    flat = lambda x: np.concatenate([np.zeros(0, dtype=np.int64), *x])
    columns = [np.repeat(np.array([x[i] for x in lists], dtype=np.int64), sizes) for i in (0, 1)] + [flat([x[2].scores for x in lists]), flat([x[2].ids for x in lists])]
    return pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])], names=[f.split()[0] for f in schema.split(", ")])


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """RESULT: for each row where ``anchor`` holds and each of its positives the first negatives, in order of score.

    ``vectors`` is (vec_id, label, embedding). A score is the product of two rows' whole
    numbers floor(scale * x). An anchor's positives are its first rows of the same label and
    another id, by falling score, then id; a positive's negatives are the first rows of other
    labels whose score is from ``low`` to ``high`` percent of the positive's.

    All rows are indexed with product codes, learned from all of them, and the norm of what
    the code leaves over. A table lookup a part gives a row's score to within the product of
    that norm and the anchor's, so what can't be among the first is left out for sure, and all
    else is scored exactly: the result has no error. Anchors go out in blocks of ``block``,
    each meeting all rows where they are; a task returns its first rows of each list.

    Rows with a null id, label or vector, a vector of another length than that of the first
    id, or a component that is null, not finite or too large for 64 bits, take no part. Repeated rows are rows of their own
    but never positives of an anchor of their id. Fewer positives or negatives than asked for
    are all returned; a positive score below 0 has no window. Other columns are ignored. An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = selected(vectors).where("vec_id IS NOT NULL AND label IS NOT NULL")
    width = first_width(rows)
    books = train(rows, parts=parts_of(width), rounds=ROUNDS, scale=scale) if width else None
    if books is None:
        return spark.createDataFrame([], RESULT)
    index = checkpoint(index_vectors(rows, books))
    asked = index.where(anchor).select("vec_id", "label", "vector")
    blocks = max(1, -(-asked.count() // block))
    asked = checkpoint(asked.repartition(blocks).withColumn("block", F.spark_partition_id()))
    found = [_block(index, asked.where(F.col("block") == b).select("vec_id", "label", "vector").toArrow(), books, positives, negatives, low, high) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def relabelled(vectors: DataFrame) -> DataFrame:
    """The table with the labels of ids divisible by 7 moved on by one, from 9 to 0."""
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))


def mined(vectors: DataFrame) -> DataFrame:
    """`mine` for the ids divisible by 100 of the embeddings table."""
    return mine(relabelled(vectors), F.col("vec_id") % 100 == 0)


ORACLE = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10"""
