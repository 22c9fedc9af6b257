"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ringlake.sources.scratch import checkpoint, new_folder, released

__all__ = ["checkpoint", "crc_mod", "hashed_bits", "hex16", "join_heavy", "labelled_sample", "map_texts", "new_folder", "packed_bits", "released", "segment_sum", "slices", "starts_of", "table"]

#: The word of all contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Characters of text that a task handles at once; bounds a Python worker's memory.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column, modulus: int):
    """crc32 of the value as text, modulo ``modulus``; null gives the crc of the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, salt: str) -> DataFrame:
    """(doc_id, text, label) of a sample of the documents with label 0 or 1.

    About ``per_class`` documents of each class, chosen by the hash of their id, or all of a
    class that has fewer. The ids are
    about 2 * ``per_class`` at most, whatever the tables hold, and so are broadcast: the
    texts stay where they are. Rows of null doc_id or null text are not in the sample; a
    document labelled both ways counts as 1; of rows that share an id the least text is in
    the sample, found in tasks first, so that the rows are bounded as the ids are.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    sizes = {r[label]: r["count"] for r in marks.groupBy(label).count().collect()}
    spread = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col(label) == 1, per_class / max(sizes.get(1, 0), 1)).otherwise(per_class / max(sizes.get(0, 0), 1))
    found = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(marks.where(spread < share)), "doc_id")
    return found.groupBy("doc_id", label).agg(F.min("text").alias("text"))


def join_heavy(rows: DataFrame, found: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` with the columns of ``found`` (key, weight, ...), which has each of their keys once, with its number of rows as ``weight``.

    A key of over a thousandth of all rows would fill one task. There can be a thousand such
    keys at most, so theirs are broadcast; the rows of the others are joined by a shuffle.
    """
    total = found.agg(F.sum(weight)).first()[0] or 0
    names = [c for c in found.columns if c not in (key, weight)]
    heavy = found.where(F.col(weight) * 1000 > total).select(key, F.struct(*names).alias("__found"))
    met = rows.join(F.broadcast(heavy), key, "left")
    own = [F.col(c) for c in rows.columns]
    others = met.where("__found IS NULL").select(*own).join(found.where(F.col(weight) * 1000 <= total), key)
    return met.where("__found IS NOT NULL").select(*own, "__found.*").unionByName(others.select(*own, *names))


def slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    docs: DataFrame,
    work: Callable[[list], Sequence[pa.Array]],
    schema: str,
    carry: Sequence[str] = ("doc_id",),
    keep: Callable[[Sequence[pa.Array]], pa.Array] | None = None,
) -> DataFrame:
    """Rows of ``carry`` columns plus the columns that ``work`` makes from slices of texts.

    ``work`` gets a list of texts (None for null) and returns an array per column of
    ``schema``. No shuffle; a task holds one Arrow batch and one slice. ``keep`` may give
    a mask of the rows to return.
    """
    names = list(carry)
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").cast("string").alias("__text"))
    made = StructType.fromDDL(schema)
    fields = [StructField(f.name, f.dataType) for f in (*source.schema.fields[:-1], *made.fields)]

    def run(batches):
        for batch in batches:
            texts = batch.column("__text")
            for a, b in slices(texts):
                arrays = work(texts.slice(a, b - a).to_pylist())
                columns = [batch.column(c).slice(a, b - a) for c in names] + list(arrays)
                result = pa.RecordBatch.from_arrays(columns, names=names + made.names)
                yield result if keep is None else result.filter(keep(arrays))

    return source.mapInArrow(run, StructType(fields))


def starts_of(counts: Sequence[int]) -> np.ndarray:
    """Offsets of consecutive runs with the given lengths, and the end of the last."""
    return np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))])


def segment_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i + 1]]; empty runs give zero."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), dtype=values.dtype)
    full = starts[:-1] < starts[1:]
    if full.any():
        out[full] = np.add.reduceat(values, starts[:-1][full], axis=0)
    return out


def hashed_bits(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 bits, the highest first, for each unsigned 64-bit hash."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def packed_bits(bits: np.ndarray) -> np.ndarray:
    """The unsigned 64-bit number of each row of 64 bits, the highest first."""
    return np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def hex16(column):
    """16 lowercase hexadecimal digits of a 64-bit number."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
