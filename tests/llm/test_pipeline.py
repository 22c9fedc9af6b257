"""The corpus pipeline against a brute-force version of all its stages, and its edge cases."""

import os
import random
import re

import pytest
from test_language_and_models import SYLLABLES, sentence
from test_native_operators import by_hand, mix_by_hand
from test_shingle_dedup import kept_by_hand

import corpus_pipeline
from ringlake.llm import sentencepiece_codec

pytestmark = pytest.mark.skipif(not os.path.exists(sentencepiece_codec.MODEL), reason="no tokenizer files here")

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, folder, rows):
    spark.createDataFrame([(i, t, x, s, len(t or "")) for i, t, x, s in rows], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def corpus(rng):
    langs = sorted(SYLLABLES)
    rows = [(i, sentence(rng, langs[i % 3], rng.randint(25, 60)), langs[i % 3], rng.choice(["a", "b", "b", None])) for i in range(60)]
    rows += [(100 + i, rows[i][1], rows[i][2], "b") for i in range(6)]  # copies
    rows += [(110 + i, rows[20 + i][1].upper(), rows[20 + i][2], "a") for i in range(3) if rows[20 + i][2] != "zz"]  # equal but for case
    for i in range(6):  # near copies: two words of fifty changed
        words = sentence(rng, langs[i % 3], 60).split()
        rows += [(120 + 2 * i, " ".join(words), langs[i % 3], "b"), (121 + 2 * i, " ".join([*words[:-1], "ba"]), langs[i % 3], "a")]
    rows += [(200, None, "xx", "a"), (201, "", "xx", "a"), (202, "12 34 -- " * 30, "xx", "a"), (203, "ba bo ti", "xx", "a"), (204, "ba bo ti ta " * 20, "xx", "b")]
    rng.shuffle(rows)
    return rows


def by_brute_force(rows):
    import sentencepiece

    rows = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    stats = [by_hand(t) for _, t, _, _ in rows]
    rows = [r for r, (n, *_, repeated) in zip(rows, stats) if n >= 20 and 100 * repeated <= 30 * n]
    stays = kept_by_hand([(i, t) for i, t, _, _ in rows])
    rows = [r for r in rows if r[0] in stays]
    _, taken = mix_by_hand([(i, t, s) for i, t, _, s in rows])
    encode = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL).encode
    return sorted((i, s or "", encode(t)) for i, t, _, s in rows for _ in range(taken[s, i] // len(t.split())))


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = corpus(random.Random(12))
    got = corpus_pipeline.run(spark, written(spark, tmp_path, rows)).collect()
    want = by_brute_force(rows)
    assert sorted((r.doc_id, r.source or "", r.ids) for r in got) == want and 40 < len(want)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    folder = written(spark, tmp_path, corpus(random.Random(13))[:12])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == list(corpus_pipeline.COLUMNS)


def test_pipeline_over_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [])).count() == 0
