"""SimHash, block tables, components and fingerprints against brute force."""

import math
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import xxhash

from ringlake.llm import doc_fingerprints, hamming, simhash_dedup


def simhash_by_hand(text):
    w = [x for x in bytes(text or "", "utf-8").lower().split()]
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by_hand(rows, radius=3):
    """Least id reached by links, by repeated scans of all pairs."""
    fp = [simhash_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fp[i] ^ fp[j]).count("1") <= radius and root[j] < root[i]:
                    root[i], changed = root[j], True
    out = {}
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out[i] = (f"{fp[i]:016x}", min(ids, default=None))
    return out


def texts(rng):
    base = " ".join(rng.choice(["Ab", "cd", "EF", "gh", "ij", "é", "k"]) for _ in range(rng.choice([3, 40, 400])))
    out = [base]
    for _ in range(rng.randint(0, 4)):
        w = base.split(" ")
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return out


def test_near_duplicates_against_all_pairs(docs_of):
    rng = random.Random(1)
    body = [t for _ in range(40) for t in texts(rng)]
    body += [None, "", " \n", "one", "one two", "ONE  two\n", body[0], body[0], "x" * 50_000, "word " * 20_000]
    rng.shuffle(body)
    rows = [(None if i % 29 == 28 else 3 * i, t) for i, t in enumerate(body)]
    rows += [rows[0], rows[0]]
    want = sorted(map(str, ((rows[i][0], *v) for i, v in groups_by_hand(rows).items())))
    got = sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in simhash_dedup.near_duplicates(docs_of(rows)).collect())
    assert got == want


def test_deduplicate_keeps_one_of_each_group(docs_of):
    rows = [(5, "a b c d"), (2, "a b c d"), (9, "q r s t u v w x y z"), (4, None), (3, "")]
    kept = simhash_dedup.deduplicate(docs_of(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 9] and kept.columns == docs_of([]).columns
    assert simhash_dedup.near_duplicates(docs_of([])).count() == 0


def test_deduplicate_tells_rows_of_one_id_apart(docs_of):
    x, y, z = "a b c d", "q r s t u v w x y z", "one other text of eight words in all"
    rows = [(1, x), (5, x), (5, y), (5, y), (7, y), (None, x), (None, z), (None, z)]
    docs = docs_of(rows).withColumnRenamed("score", "a.b c").withColumnRenamed("size", "row")
    kept = simhash_dedup.deduplicate(docs)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, x), (5, y), (None, z)]
    assert kept.columns == docs.columns and simhash_dedup.deduplicate(docs_of([])).count() == 0


@pytest.mark.parametrize("radius,blocks", [(0, 1), (3, 4), (3, 5), (3, 6), (5, 8)])
def test_close_pairs_miss_nothing(spark, radius, blocks):
    rng = random.Random(radius * 10 + blocks)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps):
        for _ in range(4):
            y = x
            for b in rng.sample(range(64), rng.randint(0, radius + 2)):
                y ^= 1 << b
            fps.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= radius}
    assert {tuple(r) for r in hamming.close_pairs(df, df, radius, blocks, ordered=True).collect()} == want


def test_components_of_a_path_a_star_and_a_ring(spark):
    path = list(range(200))
    random.Random(4).shuffle(path)
    edges = list(zip(path, path[1:])) + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in hamming.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(200)) and all(got[1000 + i] == 1000 for i in range(300)) and all(got[2000 + i] == 2000 for i in range(50))
    assert hamming.components(spark.createDataFrame([], "a long, b long")).count() == 0


# document fingerprints


@pytest.fixture
def ranges(spark, request):
    """So many ranges, which Spark may not join."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param == 1)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("ranges", [1, 4, 23], indirect=True)
def test_edited_texts_against_a_loop(docs_of, ranges):
    rng = random.Random(9)
    rows = [(i * i - 500, "".join(rng.choice("ab é😀\n") for _ in range(rng.choice([0, 1, 2, 3, 50, 900])))) for i in range(80)]
    rows += [(10**15, "Last one in order, the first of all."), (77, None)]
    rng.shuffle(rows)
    order = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in doc_fingerprints.fingerprint_report(docs_of(rows).repartition(5)).collect()}
    assert len(got) == len(rows)
    fp = {i: int(r.fingerprint, 16) for i, r in got.items()}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)]
        t, n = t or "", nxt[1] or ""
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha256(edited.encode()).hexdigest())
        assert r.near_next == 1 - bin(fp[i] ^ fp[nxt[0]]).count("1") / 64
        assert r.near_edited == 1 - bin(fp[i] ^ int(r.edited_fingerprint, 16)).count("1") / 64
        within = sum(bin(fp[i] ^ x).count("1") <= 3 for x in fp.values())
        assert r.n_within == (within if i % 50 == 0 else None)


def test_fingerprints_of_equal_texts_are_equal(docs_of):
    make = doc_fingerprints.Fingerprinter()
    a = make(["The cat sat", "x"])[0]
    assert a == make(["q w e r t y", None, "The cat sat", ""])[2] == make(["THE  cat\nsat"])[0] != 0
    assert make([None, "", " "]).tolist() == [0, 0, 0]
    near = make(["a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o q", "totally other words here in this one"])
    assert np.bitwise_count(near[0] ^ near[1]) < np.bitwise_count(near[0] ^ near[2])


def test_fingerprint_edge_cases(docs_of):
    assert doc_fingerprints.fingerprint_report(docs_of([])).count() == 0
    one = doc_fingerprints.fingerprint_report(docs_of([(50, "abcdef")])).collect()[0]
    assert one.edited_sha256 == sha256(b"abcdab").hexdigest() and one.near_next == 1.0 and one.n_within == 1
    rows = doc_fingerprints.fingerprint_report(docs_of([(None, "zzz"), (1, "bbbbbb"), (1, "aaaaaa"), (1, "aaaaaa")])).collect()
    by_hash = [("1", b"aaaaaa"), ("1", b"aaaabb"), ("1", b"bbbbzz"), ("None", b"zza")], [("1", b"bbbbaa"), ("1", b"aaaaaa"), ("1", b"aaaazz"), ("None", b"zzb")]
    assert sorted((str(r.doc_id), r.edited_sha256) for r in rows) in [sorted((i, sha256(t).hexdigest()) for i, t in x) for x in by_hash]


@pytest.mark.parametrize("ranges", [16], indirect=True)
def test_rows_of_one_id_spread_over_ranges(docs_of, ranges):
    docs = docs_of([(7 if i % 4 else i, "one two three four" if i % 2 else f"text {i}") for i in range(4000)])
    sizes = [len(x) for x in doc_fingerprints.in_order(docs).rdd.glom().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1000
    assert doc_fingerprints.compare_edits(docs).count() == 4000


def simhash_of_pairs(text):
    """Weighted SimHash by hand: votes of neighbouring words, 1 + ln n each, under the operator's own term hashes."""
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(x, 0) for x in w]
    m, cut = 2**64 - 1, int(doc_fingerprints.TEXT_BITS)

    def mixed(x):
        x = x * 0x9E3779B97F4A7C15 & m
        x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & m
        return x ^ x >> 29

    terms = Counter(mixed(a ^ (b * 0xBF58476D1CE4E5B9 & m)) >> cut for a, b in (zip(h, h[1:]) if len(h) > 1 else [(x, 0) for x in h]))
    votes = [sum((1 + math.log(n)) * (1 if mixed(t << cut & m) >> b & 1 else -1) for t, n in terms.items()) for b in range(64)]
    return sum(1 << b for b in range(64) if votes[b] > 1e-6)


def test_weighted_simhash_against_a_loop():
    rng = random.Random(2)
    texts = ["a", "a b", "a b a b a b a b", *(" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 20, 300]))) for _ in range(30))]
    assert doc_fingerprints.Fingerprinter()(texts).tolist() == [simhash_of_pairs(t) for t in texts]
    with pytest.raises(ValueError):
        doc_fingerprints.Fingerprinter()([None] * (1 << 18))
