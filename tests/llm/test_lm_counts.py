"""LM scoring counts each n-gram by itself, whatever the corpus holds."""

import random
from collections import Counter

import numpy as np
import pytest
from test_language_and_models import target_of, without_own

from ringlake.llm import lm_scoring


@pytest.mark.parametrize("part_grams,held", [(10**9, 10**9), (50_000, 10**9), (10**9, 20_000)])
def test_losses_of_many_distinct_grams(docs_of, labels_of, monkeypatch, part_grams, held):
    """About 90,000 distinct 5-grams, in one part or several, sent at once or bit by bit."""
    monkeypatch.setattr(lm_scoring, "PART_GRAMS", part_grams)
    monkeypatch.setattr(lm_scoring, "HELD_GRAMS", held)
    rng = random.Random(11)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäé😀 ", k=3000)) for _ in range(30)]
    good = list(range(0, 30, 4))
    found = lm_scoring.cross_entropy_difference(docs_of(list(enumerate(texts))), target_of(labels_of, good))
    got = {r.doc_id: r for r in found.collect()}
    for i in (0, 1):
        assert (got[i].target_loss, got[i].background_loss) == pytest.approx(without_own(texts, good, i), abs=1e-6)


@pytest.mark.parametrize("most_ids", [100, 0])
def test_slices_of_long_and_short_texts(docs_of, labels_of, monkeypatch, most_ids):
    """Slices by length, so small that each row of a partition is in one of several; ids broadcast or not."""
    monkeypatch.setattr(lm_scoring, "BROADCAST_IDS", most_ids)
    monkeypatch.setattr(lm_scoring, "SLICE_SIZES", ((10, 3), (40, 2)))
    rng = random.Random(12)
    texts = ["".join(rng.choices("abc ", k=rng.choice([1, 9, 30, 90]))) for _ in range(40)]
    good = list(range(0, 40, 3))
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(docs_of(list(enumerate(texts))).repartition(3), target_of(labels_of, good)).collect()}
    for i in range(40):
        assert (got[i].target_loss, got[i].background_loss) == pytest.approx(without_own(texts, good, i), abs=1e-9)


def test_lookup_finds_each_key_and_no_other():
    rng = np.random.default_rng(2)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 64, 5000, dtype=np.uint64), np.arange(300, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(300, dtype=np.uint64)]))
    look = lm_scoring.Lookup(keys[::2])
    assert (look(keys[::2]) == np.arange(len(keys[::2]))).all() and (look(keys[1::2]) == -1).all()
    assert (lm_scoring.Lookup(keys[:0])(keys) == -1).all()


def test_keys_of_different_grams_differ():
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefghijklmnop", k=60_000))
    keys, _ = lm_scoring._grams([text])
    pad = "\0" * 4 + text
    for k in range(1, lm_scoring.ORDER + 1):
        assert len(np.unique(keys[k - 1])) == len(Counter(pad[i + 5 - k : i + 5] for i in range(len(text))))


def test_a_large_slice_goes_past_once_for_many_pieces(spark, tmp_path, monkeypatch):
    """A slice of ten times the n-grams that are held is read once a run of texts, not once a piece, and answers the same."""
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcdefghijkl "), 400)) for _ in range(60)]
    keys = np.unique(np.concatenate([lm_scoring._grams(texts)[0].ravel(), lm_scoring.START_KEYS]))
    more = np.unique(np.concatenate([keys, rng.integers(0, 1 << 63, 300_000).astype(np.uint64)]))
    counts = {int(k): (i % 7, i % 7 + i % 11) for i, k in enumerate(more)}
    rows = [(0, int(np.uint64(k).view(np.int64)), *counts[int(k)]) for k in more]
    spark.createDataFrame(rows, "slice long, key long, target long, background long").repartition(3).write.parquet(f"{tmp_path}/part=0")
    monkeypatch.setattr(lm_scoring, "PART_GRAMS", 20_000)
    read = []
    real = lm_scoring.Answers._batches
    monkeypatch.setattr(lm_scoring.Answers, "_batches", lambda self: read.append(1) or real(self))
    answers = lm_scoring.Answers(f"file://{tmp_path}", 0, 0)
    for i in range(0, 60, 20):
        answers.prepare(texts[i : i + 20])
        for text in texts[i : i + 20]:
            asked = np.concatenate([lm_scoring._grams([text])[0].ravel(), lm_scoring.START_KEYS])
            number, t, b = answers(asked)
            assert [(int(x), int(y)) for x, y in zip(t, b)] == [counts[int(k)] for k in asked]
            assert len(np.unique(number)) == len(np.unique(asked))
    assert answers.large and len(read) == 4  # one look at its size, and one a run
