"""The mix takes each row's own copies where ids are null or repeated."""

import random
from collections import Counter

from ringlake.llm import source_mixing


def test_mixed_documents_of_null_and_repeated_ids(docs_of):
    rng = random.Random(8)
    rows = [(rng.choice([None, 7, i]), " ".join([f"w{i}"] * rng.choice([1, 5, 20])), None, rng.choice(["a", "b", "b", "b", None])) for i in range(120)]
    rows += [rows[0]] * 3
    docs = docs_of(rows)
    mixed = Counter((r.doc_id, r.source, len(r.text.split())) for r in source_mixing.mixed_documents(docs).collect())
    taken, per_size = 0, Counter()
    for r in source_mixing.mix(docs).collect():
        taken += r.taken
        per_size[r.doc_id, r.size] += r.copies
    got = Counter()
    for (i, _, n), c in mixed.items():
        got[i, n] += c
    assert +per_size == got and sum(n * c for (_, n), c in got.items()) == taken <= sum(len(t.split()) for _, t, *_ in rows)


def test_one_id_on_half_of_all_rows(docs_of):
    """Half the rows share an id, a third are equal: the stage has the words that the mix took, within its total."""
    rows = [(7 if i % 2 else i, "one two three" if i % 3 else f"w{i} x", None, "ab"[i % 5 == 0]) for i in range(600)]
    docs = docs_of(rows)
    taken = sum(r.taken for r in source_mixing.mix(docs).collect())
    stage = sum(len(r.text.split()) for r in source_mixing.mixed_documents(docs).collect())
    assert stage == taken and 0 <= sum(len(t.split()) for _, t, *_ in rows) - taken < 3
