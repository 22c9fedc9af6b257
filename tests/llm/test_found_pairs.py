"""The fingerprint search returns what it found."""

import random

from ringlake.llm import doc_fingerprints


def test_found_pairs_and_documents_against_all_pairs(spark):
    rng = random.Random(6)
    fps = [rng.getrandbits(62) for _ in range(30)]
    fps += [x ^ sum(1 << b for b in rng.sample(range(62), rng.randint(0, 5))) for x in fps]
    rows = list(enumerate(fps)) + [(None, fps[0]), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    queries = fps[:10]
    pairs = doc_fingerprints.found_pairs(df.where("doc_id < 10"), df)
    near = lambda a, b: (a ^ b).bit_count()
    want = {(a, b, near(a, b)) for a in queries for b in fps if near(a, b) <= 3}
    assert {tuple(r) for r in pairs.collect()} == want and pairs.count() == len(want)
    found = {tuple(r) for r in doc_fingerprints.found_documents(pairs, df).collect()}
    assert found == {(a, b, near(a, b), i) for a in queries for i, b in rows if b is not None and near(a, b) <= 3}
    counts = {r.fp: r.n_within for r in doc_fingerprints.within(df.where("doc_id < 10"), df).collect()}
    assert counts == {a: sum(b is not None and near(a, b) <= 3 for _, b in rows) for a in queries}
