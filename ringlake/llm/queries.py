"""Queries op1 to op13 and their SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringlake.llm import bbit_minhash, chat_format, doc_fingerprints, hard_negatives, language_id, lm_scoring, quality_rules, sentencepiece_codec, source_mixing, token_counts, toxicity, vector_codes
from ringlake.llm.common import table
from ringlake.llm.simhash_dedup import near_duplicates


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs), spans=True)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def op2_lm_scoring(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op3_chat_format(spark, sf_dir):
    return chat_format.swapped_replies(table(spark, sf_dir, "conversations"))


def op4_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark, sf_dir):
    return source_mixing.mix(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = toxicity.predict(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_token_counts(spark, sf_dir):
    return token_counts.count_tokens(token_counts.revision(table(spark, sf_dir, "documents")))


def op8_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_doc_fingerprints(spark, sf_dir):
    return doc_fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"))


def op12_minhash_near_dedup(spark, sf_dir):
    return bbit_minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("set_id")


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_chat_format": op3_chat_format,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality_rules": op9_quality_rules,
    "op10_doc_fingerprints": op10_doc_fingerprints,
    "op11_vector_codes": op11_vector_codes,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE = {
    "op3_chat_format": chat_format.ORACLE,
    "op5_source_mixing": source_mixing.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_minhash_near_dedup": bbit_minhash.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
