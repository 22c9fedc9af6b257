"""SimHash near-duplicates: unweighted votes of word shingles, pigeonhole blocks, verified distance."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlake.llm.common import checkpoint, hashed_bits, hex16, join_heavy, map_texts, packed_bits, segment_sum, starts_of
from ringlake.llm.hamming import close_pairs, components

SEED = 42


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of each run of ``words`` words, A-Z in lower case; of the whole sequence if shorter."""
    tokens = (text or "").encode("utf-8").lower().split()  # bytes: ASCII white space and A-Z only
    if not tokens:
        return []
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = [e - 1 for e in accumulate(len(t) + 1 for t in tokens)]
    begins = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(begins, ends[words - 1 :])]


def fingerprints_of(texts: list[str | None], words: int = 3) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text; a bit is set if set in over half of its shingles."""
    return voted([shingle_hashes(t, words) for t in texts])


def voted(hashes: list[list[int]]) -> np.ndarray:
    """Unsigned 64-bit SimHash of each list of shingle hashes; zero of an empty one."""
    starts = starts_of([len(h) for h in hashes])
    flat = np.fromiter((x for h in hashes for x in h), dtype=np.uint64, count=int(starts[-1]))
    votes = np.zeros((len(hashes), 64), dtype=np.int64)
    step = 1 << 16  # bounds the unpacked bits
    owner = np.repeat(np.arange(len(hashes)), np.diff(starts))
    for a in range(0, len(flat), step):
        own = owner[a : a + step]
        first, last = own[0], own[-1] + 1
        cut = np.searchsorted(own, np.arange(first, last + 1))
        votes[first:last] += segment_sum(hashed_bits(flat[a : a + step]).astype(np.int32), cut)
    return packed_bits(2 * votes > np.diff(starts)[:, None])


def fingerprint(docs: DataFrame, words: int = 3, carry=("doc_id",)) -> DataFrame:
    """``carry`` columns and ``fp`` (the fingerprint's bits as a long). Null and empty texts give zero."""

    def work(texts):
        return [pa.array(fingerprints_of(texts, words).view(np.int64))]

    return map_texts(docs, work, "fp long", carry)


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3, blocks: int = 6) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (and root, the least fingerprint reached).

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest
    doc_id that links reach. Copies count once: blocks hold distinct fingerprints only, so
    a group of copies of any size adds one row to each block table. Blocks of
    ``blocks - radius`` runs (32 bits with the defaults) keep the candidates few when rows
    are many; the links of one fingerprint are bounded by the number of 64-bit numbers in
    its ball.

    A fingerprint of over a thousandth of all rows meets its component by broadcast.
    Null and empty texts have fingerprint zero and link like any other. Rows with a null
    doc_id get the smallest doc_id of their component, null if it has none. Repeated rows
    each return a row. Other columns are ignored. An empty table gives no rows.
    """
    marked = checkpoint(fingerprint(docs, words))
    classes = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")))
    roots = components(close_pairs(classes.select("fp"), classes.select("fp"), radius, blocks, ordered=True))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", "m", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = checkpoint(rooted.select("fp", "root", "m").join(groups, "root").select("fp", "root", "component_id", "m"))
    return join_heavy(marked, named, "fp", "m").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id", hex16(F.col("root")).alias("root"))


def deduplicate(docs: DataFrame, words: int = 3, **options) -> DataFrame:
    """One document of each group: that of the smallest doc_id; all columns.

    A document is its doc_id and fingerprint, so texts that share an id are told apart and
    repeated rows count once: they are aggregated in tasks before the shuffle, a group of
    copies under one id therefore sends a row a task. Of rows with equal id and fingerprint
    that of the least text hash stays. A null doc_id comes after all others: its row stays only
    where no row of the group has an id. An empty table gives no rows.
    """
    named = near_duplicates(docs, words=words, **options)
    least = F.struct(F.col("doc_id").isNull(), "doc_id", "fingerprint")
    first = named.groupBy("root").agg(F.min(least).alias("m"))
    stays = first.select(F.struct("m.doc_id", "m.fingerprint").alias("stays"))
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = fingerprint(rows, words, carry=("row",))
    key = F.struct(F.col("row.doc_id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"))
    distinct = marked.groupBy(key.alias("key")).agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    return distinct.join(stays.hint("merge"), F.col("key") == F.col("stays"), "left_semi").select("row.*")
