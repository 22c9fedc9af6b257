"""The registered queries over small tables: columns, held-out marks, and rows against their SQL."""

import os
from zlib import crc32

import pytest

import oracle
from ringlake.llm import sentencepiece_codec
from ringlake.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF) or not os.path.exists(sentencepiece_codec.MODEL), reason="no test tables or tokenizer files here")

COLUMNS = {
    "op1": ["doc_id", "held_out", "lang_pred", "score", "spans"],
    "op2": ["doc_id", "score"],
    "op3": ["pair_id", "n_prefix", "prompt", "chosen", "chosen_spans", "rejected", "rejected_spans"],
    "op4": ["doc_id", "fingerprint", "component_id"],
    "op5": ["doc_id", "size", "source_size", "target", "taken"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_recoded"],
    "op8": ["doc_id", "n_tokens", "ids", "round_trip"],
    "op9": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
    "op10": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op11": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op12": ["doc_id", "n_shingles", "component_id", "kept"],
    "op13": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
}
TYPES = {
    "op1": {"held_out": "boolean", "lang_pred": "string", "score": "double"}, "op4": {"fingerprint": "string", "component_id": "bigint"},
    "op5": {"size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}, "op6": {"held_out": "boolean", "score": "double", "predicted": "int"},
    "op9": {**dict.fromkeys(COLUMNS["op9"], "bigint"), "base_failed": "boolean", "kept": "boolean"}, "op10": {"n_chars": "bigint", "near_edited": "double", "near_next": "double", "edited_sha256": "string"},
    "op11": {"code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
    "op12": {"n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op13": {**dict.fromkeys(COLUMNS["op13"], "bigint"), "rank": "int"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_each_query_returns_all_rows_with_its_columns(spark, name):
    op = name.split("_")[0]
    found = QUERIES[name](spark, SF)
    assert found.columns[: len(COLUMNS[op])] == COLUMNS[op]
    assert TYPES.get(op, {}).items() <= dict(found.dtypes).items()
    rows = found.collect()
    if op not in ("op3", "op11", "op13"):
        ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
        assert sorted(r.doc_id for r in rows) == sorted(ids)
    modulus, rest = {"op1": (4, 2), "op6": (5, 0)}.get(op, (1, 0))
    if modulus > 1:
        assert all(r.held_out == (crc32(str(r.doc_id).encode()) % modulus == rest) and 0 <= r.score <= 1 for r in rows)
        assert {r.held_out for r in rows} == {True, False}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_are_those_of_the_sql(spark, name):
    assert oracle.differences(QUERIES[name](spark, SF).toArrow(), oracle.tables(SF).sql(ORACLE[name]).to_arrow_table()) == []


def test_every_example_has_a_prompt_or_begins_with_its_reply(spark):
    rows = QUERIES["op3_chat_format"](spark, SF).collect()
    assert len(rows) > 10 and all(r.n_prefix > 0 and r.prompt for r in rows if r.pair_id % 2 == 0 or r.n_prefix)
    assert sum(r.n_prefix > 0 for r in rows) > 0.9 * len(rows)
