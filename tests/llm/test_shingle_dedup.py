"""Near-duplicates of the pipeline against all pairs of shingle sets."""

import random

import corpus_pipeline
from ringlake.llm import shingle_dedup, simhash_dedup


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def kept_by_hand(rows, percent=80):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, any_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both * 100 >= any_ * percent and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    return sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root))


def near_copies(rng, n_base, most):
    rows = []
    for _ in range(n_base):
        base = [rng.choice("abcdefghij") + str(rng.randrange(3000)) for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.randint(1, most)):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 25)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    return rows


def test_dedup_stage_links_near_copies(spark, docs_of):
    rng = random.Random(3)
    texts = near_copies(rng, 25, 6) + near_copies(rng, 1, 1) * 3 + [None, "", " ", "one two", "ONE  two", "one"]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"q{k}x{i}" for i in range(60)) for k in range(12)]
    base = [f"c{i}" for i in range(104)]  # a chain: each is near the next only
    texts += [" ".join(base[k * 6 : k * 6 + 80]) for k in range(5)]
    rng.shuffle(texts)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    kept = corpus_pipeline.dedup_stage(spark, docs_of(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == kept_by_hand(rows)


def test_large_group_makes_few_pairs_and_one_row(docs_of):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(200)] = w[rng.randrange(200)] = f"n{i}"
        rows.append((i + 10, " ".join(w)))
    assert [r.doc_id for r in shingle_dedup.deduplicate(docs_of(rows)).collect()] == [10]


def test_rows_of_one_id_and_null_ids(docs_of):
    x, y, z = "a b c d e f", "q r s t u v w x y z", "one other text of eight words in all"
    rows = [(1, x), (5, x), (5, y), (5, y), (7, y), (None, x), (None, z), (None, z)]
    docs = docs_of(rows).withColumnRenamed("score", "a.b c").withColumnRenamed("size", "row")
    kept = shingle_dedup.deduplicate(docs)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, x), (5, y), (None, z)]
    assert kept.columns == docs.columns and shingle_dedup.deduplicate(docs_of([])).count() == 0


def test_simhash_links_first_and_the_rest_is_searched(spark, docs_of, monkeypatch):
    """The stage's fingerprints are op4's, of five words; block tables give near copies, and bands get what is left apart."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base)] + [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in (0, 1, 398, 399)]
    texts += near_copies(rng, 10, 2)
    rows = list(enumerate(texts))
    docs = docs_of(rows)
    marked = shingle_dedup.signatures(docs, 5, simhash=True).collect()
    prints = {r.doc_id: r.fp for r in simhash_dedup.fingerprint(docs, 5).collect()}
    assert {r.doc_id: r.fp for r in marked} == prints
    of = {r.sid: r for r in marked}
    pairs = shingle_dedup.fingerprint_pairs(shingle_dedup.signatures(docs, 5, simhash=True).select("sid", "n", "fp")).collect()
    assert pairs and all(bin((of[p.sid].fp ^ of[p.other].fp) & (1 << 64) - 1).count("1") <= 3 for p in pairs)
    asked = []
    search = shingle_dedup.fingerprint_pairs
    monkeypatch.setattr(shingle_dedup, "fingerprint_pairs", lambda sized: asked.append(1) or search(sized))
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()) == kept_by_hand(rows) and asked
