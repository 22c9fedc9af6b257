"""One document of each group of near-duplicates: SimHash block tables link first, `bbit_minhash` finds what they leave apart, and whole rows stay."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlake.llm.bbit_minhash import Filter, signatures, similar_roots
from ringlake.llm.common import released
from ringlake.llm.hamming import block_table


def fingerprint_pairs(sized: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(sid, n, ..., other, other_n, ...), once each, of sets (sid, n, ..., fp) whose fingerprints differ in ``radius`` bits or fewer.

    One set stands for each fingerprint and is paired with the others that have it. Distinct
    fingerprints go to block tables, as in op4; of each bucket that which comes first by its
    hash is paired with the others within the radius. So a group of near copies makes as many
    pairs as it has sets, not their square.
    """
    carried = [c for c in sized.columns if c not in ("sid", "fp")]
    one = lambda x: [F.col(f"{x}.{c}") for c in ("sid", *carried)]
    other = lambda x: [F.col(f"{x}.sid").alias("other"), *[F.col(f"{x}.{c}").alias(f"other_{c}") for c in carried]]
    classes = released(sized.groupBy("fp").agg(F.min(F.struct("sid", *carried)).alias("one")))
    equal = sized.join(classes, "fp").where("sid <> one.sid").select("sid", *carried, *other("one"))
    table = released(block_table(classes.select("fp"), radius, blocks))
    heads = table.groupBy("block", "key").agg(F.min_by("fp", F.xxhash64("fp")).alias("head"), F.count("*").alias("m")).where("m > 1").drop("m")
    met = table.join(heads, ["block", "key"]).where(F.col("fp") != F.col("head"))
    near = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("head"))) <= radius).select(F.least("fp", "head").alias("fp"), F.greatest("fp", "head").alias("head")).distinct()
    of = lambda c, x: classes.select(F.col("fp").alias(c), F.col("one").alias(x))
    apart = near.join(of("fp", "x"), "fp").join(of("head", "y"), "head").select(*one("x"), *other("y"))
    return equal.unionByName(apart)


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of texts that are similar, directly or by links: that of the smallest doc_id; all columns.

    Texts are sets of ``words``-word shingles (A-Z in lower case; a shorter text is one
    shingle) and link at a Jaccard similarity of ``percent`` in a hundred or more. SimHash
    fingerprints of the same shingles that differ in 3 bits or fewer are candidates first,
    found by block tables. Pairs at 0.8 differ in some 10 bits, so that MinHash bands and packed
    signatures then search what those links leave apart; they miss a pair at 0.8 with
    probability 6e-8. Every pair is checked exactly. Null and empty texts are equal to each other and to no other.

    Texts that share an id are told apart and repeated rows count once. A null doc_id comes
    after all others: its row stays only where no row of the group has an id. An empty table
    gives no rows.
    """
    marked = released(signatures(docs, words, simhash=True))
    roots = similar_roots(docs, marked, words, percent, fingerprint_pairs)
    least = marked.groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sid", "h")).alias("m"))
    named = least.join(roots, least["sid"] == roots["node"], "left").select("m", F.coalesce("root", "sid").alias("root"))
    stays = released(named.groupBy("root").agg(F.min("m").alias("m")).select(F.struct("m.doc_id", "m.h").alias("stays")))

    # texts of keys that stay and come once needn't move; the filter lets a few of them through, and no other
    keys = marked.groupBy(F.struct("doc_id", "h").alias("key")).agg(F.count("*").alias("times")).join(stays, F.col("key").eqNullSafe(F.col("stays")), "left")
    moving = Filter(released(keys.where("stays IS NULL OR times > 1").select(F.xxhash64("key.doc_id", "key.h").alias("k"))), "k")

    @F.pandas_udf("boolean")
    def moves(k: pd.Series) -> pd.Series:
        return pd.Series(moving.may_hold(k.to_numpy(np.int64)))

    columns = [F.col(f"`{c}`") for c in docs.columns]
    told = docs.select(F.struct(*columns).alias("row"), F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"))
    told = told.withColumn("moves", moves(F.xxhash64("key.doc_id", "key.h")))
    distinct = told.where("moves").groupBy("key").agg(F.min("row").alias("row"))
    kept = distinct.join(stays, F.col("key").eqNullSafe(F.col("stays")), "left_semi")
    return told.where("NOT moves").select("row.*").unionByName(kept.select("row.*"))
