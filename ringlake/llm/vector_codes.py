"""Product codes of vectors: integer codebooks by rounds of nearest entries, found in kd-trees, and of integer sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlake.llm.common import checkpoint

#: Entries of a leaf of a tree: few enough to skip many, enough for one matrix product.
LEAF = 16
#: Squared distances must fit 64 bits, whatever the vectors.
LARGEST_SUM = 1 << 62
#: Whole numbers up to this are exact as doubles.
EXACT = 1 << 53
#: Parts that a label's total is copied to, so that a label of any share of the rows meets it in many tasks.
SALTS = 32

CODED = "vec_id long, label long, codes binary, error long"


class Tree:
    """A kd-tree over the entries of one codebook; entries and queries are whole numbers, distances exact."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, dtype=np.int64)
        self.largest = int(np.abs(self.entries).max(initial=0))
        self.nodes: list[tuple] = []
        self._build(np.arange(len(self.entries)))

    def _build(self, rows: np.ndarray) -> int:
        """A node is (rows,) where it ends, else (dimension, end of the left side, begin of the right, left, right)."""
        own, me = self.entries[rows], len(self.nodes)
        spread = own.max(axis=0) - own.min(axis=0)
        dim = int(spread.argmax())
        if len(rows) <= LEAF or spread[dim] == 0:
            self.nodes.append((np.sort(rows),))
            return me
        order = rows[np.argsort(own[:, dim], kind="stable")]
        half = len(order) // 2
        self.nodes.append(())
        ends = int(self.entries[order[half - 1], dim]), int(self.entries[order[half], dim])
        self.nodes[me] = (dim, *ends, self._build(order[:half]), self._build(order[half:]))
        return me

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the entry nearest to each query; of equally near ones the lowest index.

        Queries go down the tree together. Each first meets the leaf on its own side of all
        splits; then every node whose box is no farther than the best so far is visited, also
        where it is just as far: it may hold an entry of that distance and a lower index.
        """
        largest = max(self.largest, int(np.abs(queries).max(initial=0)))
        kind = np.float64 if queries.shape[1] * 4 * largest * largest < EXACT else np.int64
        q, e = queries.astype(kind), self.entries.astype(kind)
        squares, e_squares = (q * q).sum(axis=1), (e * e).sum(axis=1)
        far = np.inf if kind is np.float64 else np.iinfo(np.int64).max
        best, at = np.full(len(q), far, dtype=kind), np.full(len(q), len(e), dtype=np.int64)
        home = np.zeros(len(q), dtype=np.int64)

        def meet(rows: np.ndarray, members: np.ndarray) -> None:
            d = e_squares[members] - 2 * (q[rows] @ e[members].T)
            k = d.argmin(axis=1)
            d, k = d[np.arange(len(rows)), k] + squares[rows], members[k]
            better = (d < best[rows]) | ((d == best[rows]) & (k < at[rows]))
            best[rows[better]], at[rows[better]] = d[better], k[better]

        def descend(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if len(self.nodes[node]) == 1:
                home[rows] = node
                return meet(rows, self.nodes[node][0])
            dim, low, high, left, right = self.nodes[node]
            near_left = 2 * q[rows, dim] <= low + high
            descend(left, rows[near_left])
            descend(right, rows[~near_left])

        def visit(node: int, rows: np.ndarray, bound: np.ndarray, box: dict[int, tuple]) -> None:
            open_ = bound <= best[rows]
            rows, bound = rows[open_], bound[open_]
            if not len(rows):
                return
            if len(self.nodes[node]) == 1:
                rows = rows[home[rows] != node]
                return meet(rows, self.nodes[node][0]) if len(rows) else None
            dim, low, high, left, right = self.nodes[node]
            x, (a, b) = q[rows, dim], box.get(dim, (None, None))

            def beyond(a, b) -> np.ndarray:
                """Squared distance from the interval a to b, either open where it is None."""
                out = np.zeros_like(x)
                if a is not None:
                    np.maximum(out, a - x, out=out)
                if b is not None:
                    np.maximum(out, x - b, out=out)
                return out * out

            rest = bound - beyond(a, b)
            visit(left, rows, rest + beyond(a, low), box | {dim: (a, low)})
            visit(right, rows, rest + beyond(high, b), box | {dim: (high, b)})

        everything = np.arange(len(q))
        descend(0, everything)
        visit(0, everything, np.zeros(len(q), dtype=kind), {})
        return at, best.astype(np.int64)


@dataclass(frozen=True)
class Codebooks:
    """What vectors are coded with: a table of entries for each part, and the number that components are multiplied by."""

    tables: tuple[np.ndarray, ...]
    width: int
    scale: int

    @property
    def text(self) -> str:
        """All components by part, entry and position, joined by commas."""
        return ",".join(str(x) for t in self.tables for x in t.ravel().tolist())

    @property
    def sha256(self) -> str:
        return sha256(self.text.encode()).hexdigest()

    def trees(self) -> list[Tree]:
        return [Tree(t) for t in self.tables]

    def decode(self, codes: bytes) -> np.ndarray:
        """The whole numbers that a code stands for."""
        return np.concatenate([t[k] for t, k in zip(self.tables, codes)])


def selected(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) as the operators here take them; other columns are left behind."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))


def whole_vectors(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, whole numbers) of the vectors of ``width`` components, each floor(scale * x), that have all of them.

    A null, NaN or infinite component, or one so large that squared distances would not fit
    64 bits, leaves the row out, as do a null vector and one of another length.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = pc.equal(pc.list_value_length(column), width).fill_null(False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    with np.errstate(invalid="ignore", over="ignore"):
        numbers = np.floor(flat * scale)
        good = (np.abs(numbers) <= int((LARGEST_SUM / max(width, 1)) ** 0.5) // 2).all(axis=1)
    return rows[good], numbers[good].astype(np.int64)


def first_width(vectors: DataFrame) -> int | None:
    """Components of the vector of the smallest vec_id (null last) that is whole and not empty; None without one."""
    whole = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    found = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole).agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", F.size("embedding").alias("n"))).alias("m")).first()
    return found.m.n if found.m is not None else None


def _starts(vectors: DataFrame, width: int, scale: int, entries: int) -> np.ndarray:
    """The vectors of the ``entries`` smallest vec_ids, ascending; equal ids by their components, null ids last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers = whole_vectors(batch.column("embedding"), width, scale)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(numbers.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), lists], names=["vec_id", "v"])

    made = vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, v array<long>")
    first = made.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v")
    return np.array(first.to_pylist(), dtype=np.int64).reshape(-1, width)


def _round(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Every part goes to its nearest entry; an entry becomes the floor of the mean of its parts, one without parts stays.

    A task adds up whole numbers; a row for each entry that it met leaves it, so what the
    driver gets is of the size of the codebooks.
    """
    spark, parts, each = vectors.sparkSession, len(books.tables), books.width // len(books.tables)
    width, scale, entries = books.width, books.scale, len(books.tables[0])
    shared = spark.sparkContext.broadcast(books.trees())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, each), dtype=np.int64), np.zeros(parts * entries, dtype=np.int64)
        for batch in batches:
            _, numbers = whole_vectors(batch.column("embedding"), width, scale)
            for p, tree in enumerate(shared.value):
                own = numbers[:, p * each : (p + 1) * each]
                at = tree.nearest(own)[0] + p * entries
                order = np.argsort(at, kind="stable")
                met, first = np.unique(at[order], return_index=True)
                if len(met):
                    sums[met] += np.add.reduceat(own[order], first, axis=0)
                    counts += np.bincount(at, minlength=len(counts))
        met = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1, dtype=np.int32) * each), pa.array(sums[met].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met]), lists], names=["entry", "n", "s"])

    added = vectors.select("embedding").mapInArrow(run, "entry int, n long, s array<long>").groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(each)])
    tables = np.concatenate(books.tables).astype(np.int64)
    for row in added.collect():
        tables[row.entry] = [row[f"s{i}"] // row.n for i in range(each)]
    shared.unpersist()
    return Codebooks(tuple(np.split(tables, parts)), width, scale)


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks of ``entries`` entries (all vectors, if fewer) for each of ``parts`` equal runs of components; None without vectors.

    Components are the whole numbers floor(scale * x). Entries start as the parts of the
    smallest vec_ids. Each round reads all vectors once, where they are: trees go out, sums
    come back. Codes are bytes, so that ``entries`` is 256 at most.

    The number of components is that of the vector of the smallest vec_id; vectors that are
    null, of another length, or hold a null or non-finite component (or one whose square
    doesn't fit) take no part. Of equal vec_ids the lesser vector comes first, null ids come
    last; repeated rows count as often as they are there. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    vectors = selected(vectors)
    width = first_width(vectors)
    if width is None:
        return None
    if width % parts:
        raise ValueError(f"{width} components don't make {parts} equal parts")
    starts = _starts(vectors, width, scale, entries)
    if not len(starts):
        return None
    books = Codebooks(tuple(np.split(starts, parts, axis=1)), width, scale)
    for _ in range(rounds):
        books = _round(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks | None) -> DataFrame:
    """(vec_id, label, codes, error) of each whole vector: a byte a part, and its squared distance from what the bytes stand for."""
    spark, vectors = vectors.sparkSession, selected(vectors)
    if books is None:
        return spark.createDataFrame([], CODED)
    width, scale, each = books.width, books.scale, books.width // len(books.tables)
    shared = spark.sparkContext.broadcast(books.trees())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers = whole_vectors(batch.column("embedding"), width, scale)
            found = [tree.nearest(numbers[:, p * each : (p + 1) * each]) for p, tree in enumerate(shared.value)]
            codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0, dtype=np.int64)
            kept = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(kept), batch.column("label").take(kept), bytes_rows(codes), pa.array(error)],
                names=["vec_id", "label", "codes", "error"],
            )

    return vectors.mapInArrow(run, CODED)


def bytes_rows(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    raw = np.ascontiguousarray(rows)
    size = raw.shape[1] * raw.itemsize
    offsets = pa.py_buffer(np.arange(len(raw) + 1, dtype=np.int32) * np.int32(size))
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, offsets, pa.py_buffer(raw.tobytes())])


def code_report(vectors: DataFrame) -> DataFrame:
    """One row per whole vector: vec_id, code (hex), error, label_error, codebooks_sha256.

    label_error is the error summed over all rows of an equal label, nulls being equal. It is
    added up in tasks first, and joined back through SALTS copies of each label's total, so
    that rows of one label are spread over tasks. An empty table, or one without whole
    vectors, gives no rows.
    """
    books = train(vectors)
    coded = checkpoint(encode(vectors, books))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    copies = totals.select(F.col("label").alias("own"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "codes", "error"), F.lit(SALTS)).cast("int"))
    found = dealt.join(copies, (dealt["salt"] == copies["salt"]) & F.col("label").eqNullSafe(F.col("own")))
    return found.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.sha256 if books else None).cast("string").alias("codebooks_sha256"))


def _rounds_sql(rounds: int, parts: int, each: int) -> str:
    """The codebooks e0 to e<rounds>, nearest entries n0 to n<rounds> with m = distance * 1024 + index."""
    ctes = [f"""kept AS (SELECT vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
cut AS MATERIALIZED (SELECT vec_id, label, p, part, list_inner_product(part, part) AS vv FROM (SELECT vec_id, label, p, v[p * {each} + 1 : p * {each} + {each}] AS part FROM kept, (SELECT unnest(range({parts})) AS p))),
e0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, part AS e FROM cut QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 256)"""]
    for i in range(rounds + 1):
        ctes.append(f"n{i} AS MATERIALIZED (SELECT vec_id, label, p, any_value(part) AS part, min((vv - 2 * list_inner_product(part, e) + list_inner_product(e, e))::BIGINT * 1024 + k) AS m FROM cut JOIN e{i} USING (p) GROUP BY vec_id, label, p)")
        if i < rounds:
            ctes.append(f"u{i} AS (SELECT p, k, list(x ORDER BY i) AS e FROM (SELECT p, m % 1024 AS k, i, floor(sum(part[i]) / count(*)) AS x FROM n{i}, (SELECT unnest(range(1, {each + 1})) AS i) GROUP BY p, m % 1024, i) GROUP BY p, k)")
            ctes.append(f"e{i + 1} AS MATERIALIZED (SELECT o.p, o.k, coalesce(u.e, o.e) AS e FROM e{i} o LEFT JOIN u{i} u ON u.p = o.p AND u.k = o.k)")
    return ",\n".join(ctes)


#: 64 components, as the embeddings table has them.
ORACLE = f"""WITH {_rounds_sql(4, 4, 16)},
coded AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(m % 1024)), 2, '0'), '' ORDER BY p) AS code, sum(m // 1024)::BIGINT AS error FROM n4 GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, k, i)) FROM (SELECT p, k, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM e4)) AS codebooks_sha256 FROM coded"""
