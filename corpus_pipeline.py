"""Corpus pipeline: language ID, quality rules, near-duplicates, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but
the last return the columns of documents. `run` chains them over the documents table; a
caller may also write each stage's rows and read them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlake.llm import language_id, quality_rules, sentencepiece_codec, shingle_dedup, source_mixing
from ringlake.llm.common import checkpoint, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A text goes if less than this of it is surely of the language that it is mostly in.
MIN_LANGUAGE_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language. The model learns from the documents at hand.

    Null texts and texts without a letter go, as do texts of which less than MIN_LANGUAGE_SCORE
    is surely of one language; a score of just that stays. Rows are judged one by one: repeated
    rows stay or go together, null ids and languages count as any. Of equally likely languages
    the first by name is taken. Without a learned language, as in an empty table, nothing stays.
    """
    kept = language_id.predict(docs, language_id.train(docs), carry=COLUMNS, min_score=MIN_LANGUAGE_SCORE)
    return kept.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the decision list learned from labels.

    Null and empty texts fail the base rule. Rows are judged one by one: repeated rows stay or
    go together, null ids teach nothing. Values at a threshold are not above it. Without
    labels the base rule alone decides; an empty table gives no rows.
    """
    return quality_rules.quality_filter(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    SimHash fingerprints of 3 or fewer differing bits, found by block tables as in op4, link
    first, where their sets reach 0.8. Pairs at 0.8 differ in some 10 bits, too many for block
    tables: what the fingerprints leave apart is searched by MinHash bands and packed
    signatures, as in op12. Null and empty texts are copies of each other. Repeated rows count once; rows of one id but different texts are told apart; of equal
    smallest ids the smallest set hash stays. A null id comes after all others. An empty
    table gives no rows.
    """
    return shingle_dedup.deduplicate(docs, words=5, percent=80).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken.

    The null source is a source; texts without a word are never taken. Each row has its own
    copies, also where ids are null or repeated; equal rows share theirs. Ties of virtual time
    go by source, hashed id, id, size and copy. An empty table gives no rows.
    """
    return source_mixing.mixed_documents(docs).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and round_trip of each document of the mix.

    Each row gives a row, repeated ones too; null and empty texts have no ids; an empty table
    gives no rows.
    """
    return sentencepiece_codec.encode(docs, carry=("doc_id", "source"))


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("near_dedup", dedup_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", tokens_stage),
]

#: Language ID, near-duplicates and SentencePiece have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; rows between stages go to the checkpoint folder."""
    docs = table(spark, sf_dir, "documents").select(*[F.col(c) for c in COLUMNS])
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else checkpoint(docs), sf_dir)
    return docs
