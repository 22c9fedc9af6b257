"""Document fingerprints: weighted SimHash, block-table search, and a comparison with edited texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ringlake.llm.common import SLICE_CHARS, checkpoint, hashed_bits, hex16, map_texts, packed_bits, segment_sum, starts_of
from ringlake.llm.hamming import close_pairs

CACHE = 500_000
#: A call takes fewer than 2^TEXT_BITS texts; the other bits of a sort key are the term's.
TEXT_BITS = np.uint64(18)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _mixed(h: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    h = h * MIX[0]
    h = (h ^ (h >> np.uint64(31))) * MIX[1]
    return h ^ (h >> np.uint64(29))


class Fingerprinter:
    """Weighted SimHash of texts: terms are pairs of neighbouring words (one word alone is a term).

    Words are runs of characters other than ASCII white space, A-Z in lower case. A term that
    occurs n times votes with weight 1 + ln n on the sign of each bit. Hashes of words are
    kept between calls, CACHE of them at most.
    """

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w, 0)
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))

    def __call__(self, texts: Sequence[str | None]) -> np.ndarray:
        if len(texts) >= 1 << int(TEXT_BITS):
            raise ValueError(f"fewer than {1 << int(TEXT_BITS)} texts a call")
        lists = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        starts = starts_of([len(x) for x in lists])
        h = self.word_hashes([w for x in lists for w in x])
        counts = np.diff(starts)
        owner = np.repeat(np.arange(len(texts)), counts)
        after = np.zeros(len(h), dtype=np.uint64)
        after[:-1] = h[1:]
        single = np.repeat(counts == 1, counts)
        after[single] = 0
        last = np.zeros(len(h), dtype=bool)
        last[starts[1:][counts > 1] - 1] = True
        # sorting text number and term as one number brings equal terms of a text together
        term = _mixed(h ^ (after * MIX[1])) >> TEXT_BITS
        key = np.sort(((owner.astype(np.uint64) << (np.uint64(64) - TEXT_BITS)) | term)[~last])
        fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        weight = (1 + np.log(np.diff(np.append(fresh, len(key))))).astype(np.float32)
        key = key[fresh]
        owner = (key >> (np.uint64(64) - TEXT_BITS)).astype(np.int64)
        term = _mixed(key << TEXT_BITS)
        votes = np.zeros((len(texts), 64), dtype=np.float64)
        for a in range(0, len(key), 1 << 15):
            own = owner[a : a + (1 << 15)]
            cut = np.searchsorted(own, np.arange(own[0], own[-1] + 2))
            signs = hashed_bits(term[a : a + (1 << 15)]).astype(np.float32) * 2 - 1
            votes[own[0] : own[-1] + 1] += segment_sum(signs * weight[a : a + (1 << 15), None], cut)
        return packed_bits((votes > 1e-9).astype(np.uint8))


def fingerprint(docs: DataFrame, carry=("doc_id",)) -> DataFrame:
    """``carry`` columns and ``fp`` of each whole text. Null texts are empty and have fingerprint zero."""
    make: list[Fingerprinter] = []

    def work(texts):
        make or make.append(Fingerprinter())
        most = (1 << int(TEXT_BITS)) - 1
        return [pa.array(np.concatenate([make[0](texts[a : a + most]) for a in range(0, len(texts), most)]).view(np.int64))]

    return map_texts(docs, work, "fp long", carry)


def found_pairs(queries: DataFrame, fingerprints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(fp, found_fp, distance): all fingerprints within the radius of each distinct query fingerprint, its own too.

    Blocks hold distinct fingerprints, so copies add nothing. Exact: the block tables miss
    no fingerprint within the radius.
    """
    distinct = [x.where("fp IS NOT NULL").select("fp").distinct() for x in (queries, fingerprints)]
    pairs = close_pairs(*distinct, radius, blocks, ordered=False)
    return pairs.select(F.col("a").alias("fp"), F.col("b").alias("found_fp"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("distance"))


def found_documents(pairs: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(fp, found_fp, distance, doc_id): the rows of ``fingerprints`` (doc_id, fp) behind `found_pairs`."""
    rows = fingerprints.select("doc_id", F.col("fp").alias("found_fp"))
    return pairs.join(rows, "found_fp").select("fp", "found_fp", "distance", "doc_id")


def within(queries: DataFrame, fingerprints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(fp, n_within): for each distinct query fingerprint the number of rows behind its `found_pairs`; each row counts."""
    sizes = fingerprints.where("fp IS NOT NULL").groupBy(F.col("fp").alias("found_fp")).agg(F.count("*").alias("n"))
    pairs = found_pairs(queries, fingerprints, radius, blocks)
    return pairs.join(sizes, "found_fp").groupBy("fp").agg(F.sum("n").alias("n_within"))


#: What `compare_edits` finds out about a document, and what waits at the borders of partitions.
FOUND = "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"
DONE, HEAD, TAIL = 0, 1, 2


def _compared(make: Fingerprinter, rows: Sequence[tuple[int | None, str, str]]) -> list[pa.Array]:
    """The columns of FOUND of (doc_id, text, next text)."""
    ids, texts, following = zip(*rows)
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, following)]
    own, changed = make(texts), make(edited)
    # the next document is mostly the next row
    at = [i + 1 if i + 1 < len(texts) and texts[i + 1] is n else None for i, n in enumerate(following)]
    others = make([n for n, i in zip(following, at) if i is None])
    beside = np.empty(len(rows), dtype=np.uint64)
    new = np.array([i is None for i in at])
    beside[new] = others
    beside[~new] = own[[i for i in at if i is not None]]
    alike = [1 - np.bitwise_count(own ^ x).astype(np.float64) / 64 for x in (changed, beside)]
    digests = [sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(digests), pa.array(own.view(np.int64)), pa.array(changed.view(np.int64)), *map(pa.array, alike)]


def _pieces(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (doc_id, text, ...) in lists of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size > SLICE_CHARS // 2 or len(held) >= 4096:
            yield held
            held, size = [], 0
    if held:
        yield held


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in partitions of consecutive documents: descending doc_id, null last, then by a hash of the text.

    Spark cuts the ranges by a sample of keys. The last part of the order is the row's place,
    so that rows of one id, and equal rows too, spread over as many partitions as they need.
    """
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumns({"__h": F.xxhash64("text"), "__place": F.monotonically_increasing_id()})
    order = [F.desc_nulls_last("doc_id"), F.col("__h"), F.col("__place")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def compare_edits(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and how alike they are.

    The edited text has the last floor(n / 3) code points replaced by the first as many of
    the next document in descending doc_id; after the last comes the first; a single
    document follows itself. near_edited and near_next are the share of equal bits with the
    edited text's fingerprint and the next document's. Null texts count as empty. Rows of
    equal doc_id come in order of a hash of their texts, rows of null doc_id after all others;
    each returns a row. An empty table gives none. Other columns are ignored.

    Texts are shuffled once, by range. A partition compares its rows with their next ones; its
    first and last text go to a table of borders, two rows a partition, which is joined to
    itself by the number of the next partition that has rows.
    """

    def compare(batches):
        make, part = Fingerprinter(), TaskContext.get().partitionId()
        ends: list[tuple] = []

        def rows():
            held = None
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    text = text or ""
                    if held is None:
                        ends.append((HEAD, doc_id, text))
                    else:
                        yield *held, text
                    held = doc_id, text
            if held is not None:
                ends.append((TAIL, *held))

        def batch_of(kinds, columns, texts):
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([part] * len(kinds), pa.int32()), pa.array(texts, pa.string()), *columns], names=["kind", "part", "text", *names])

        for piece in _pieces(rows()):
            yield batch_of([DONE] * len(piece), _compared(make, piece), [None] * len(piece))
        if ends:
            nothing = [pa.nulls(len(ends), t) for t in kinds_of[1:]]
            yield batch_of([e[0] for e in ends], [pa.array([e[1] for e in ends], pa.int64()), *nothing], [e[2] for e in ends])

    def compare_borders(batches):
        make = Fingerprinter()
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next"))))
        for piece in _pieces(rows):
            yield pa.RecordBatch.from_arrays(_compared(make, piece), names=names)

    schema = StructType.fromDDL(FOUND)
    names, kinds_of = schema.names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    found = checkpoint(in_order(docs).mapInArrow(compare, f"kind int, part int, text string, {FOUND}"))
    heads = found.where(F.col("kind") == HEAD).select(F.col("part").alias("head_part"), F.col("text").alias("next"))
    tails = found.where(F.col("kind") == TAIL).select("doc_id", "text", "part")
    # numbers of partitions only: a small row for each
    parts = heads.select(F.col("head_part").alias("p"))
    everywhere = Window.partitionBy(F.lit(0))
    follows = parts.select("p", F.coalesce(F.lead("p").over(everywhere.orderBy("p")), F.min("p").over(everywhere)).alias("head_part"))
    borders = tails.join(follows, F.col("part") == F.col("p")).join(heads, "head_part").select("doc_id", "text", "next")
    return found.where(F.col("kind") == DONE).select(*names).union(borders.mapInArrow(compare_borders, FOUND))


def fingerprint_report(docs: DataFrame, radius: int = 3, every: int = 50) -> DataFrame:
    """`compare_edits` with hexadecimal fingerprints, and n_within for rows whose doc_id is divisible by ``every``.

    n_within is the number of rows of the table, the row itself included, whose fingerprint
    is within ``radius`` bits, found by the block tables; null for rows that are no queries.
    """
    rows = checkpoint(compare_edits(docs))
    found = within(rows.where(F.col("doc_id") % every == 0), rows, radius)
    is_query = F.col("doc_id") % every == 0
    return rows.join(found, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("edited_fp")).alias("edited_fingerprint"),
        "near_edited", "near_next", F.when(is_query, F.col("n_within")).alias("n_within"),
    )
