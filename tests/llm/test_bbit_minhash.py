"""b-bit MinHash near-duplicates: against all pairs, its estimate, its filter, parts of large groups, and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringlake.llm import bbit_minhash
from ringlake.llm.bbit_minhash import BITS, MINIMA, Filter, band_keys, estimated, least_estimate, linked, minima, near_duplicates, packed, signatures
from ringlake.llm.common import join_heavy


def shingles(text, words=4):
    tokens = [t for t in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if t]
    return {" ".join(tokens[i : i + words]) for i in range(max(len(tokens) - words + 1, 1))} if tokens else set()


def plain(rows, percent=80):
    """(doc_id, n_shingles, component_id) of each row by all pairs of texts."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def corpus(seed=1):
    """Groups of near copies, edited ones of edited ones, exact copies, and texts that share passages only."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    passage, texts = fresh(30), []
    for _ in range(12):
        base = fresh(rng.choice([20, 60, 150]))
        line = base
        for k in range(12):
            texts.append(edited(rng, base, k // 2))
            line = edited(rng, line, 1)
            texts.append(line)
        texts += [base] * 5
    texts += [fresh(25) + passage for _ in range(30)] + [fresh(4) for _ in range(5)] + [fresh(2)] * 3
    rows = [" ".join(w.upper() if rng.random() < 0.1 else w for w in t) for t in texts]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [0, 4, 12])
def test_components_are_those_of_all_pairs(docs_of, monkeypatch, small):
    monkeypatch.setattr(bbit_minhash, "COMPARED", 3)  # groups of more than three are dealt into parts
    monkeypatch.setattr(bbit_minhash, "SMALL_BUCKET", small)  # open buckets by their pairs, or by rare shingles
    rows = list(enumerate(corpus()))
    found = near_duplicates(docs_of(rows).repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(plain(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert len({r.component_id for r in found}) < len(rows) - 100


def test_nulls_empty_short_and_repeated_rows(docs_of):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one\ttwo"), (6, "one two three"), (None, "one two"), (7, "a b c d e"), (7, "a b c d e"), (None, "q r s t u v"), (None, "q r s t u v"), (8, "a b c d e")]
    found = near_duplicates(docs_of(rows)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=key) == sorted(plain(rows), key=key)
    kept = sorted(((r.doc_id, r.n_shingles, r.kept) for r in found), key=key)
    assert (None, 1, False) in kept and kept.count((None, 3, True)) == 2 and (4, 1, True) in kept and (5, 1, False) in kept and (2, 0, True) in kept


def test_an_empty_table(docs_of):
    found = near_duplicates(docs_of([]))
    assert found.collect() == [] and found.columns == ["doc_id", "n_shingles", "component_id", "kept", "set_id"]


def test_very_long_and_equal_texts(docs_of):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long), (2, long + " end"), (3, long.replace("w7 ", "v7 ")), (4, "w " * 30_000)] + [(i, "the same text again and again") for i in range(10, 200)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs_of(rows)).collect()}
    assert [found[i] for i in (1, 2, 3, 4)] == [(29_997, 1), (29_998, 1), (29_997, 1), (1, 4)]
    assert {found[i] for i in range(10, 200)} == {(3, 10)}


def planted(rng, similarity, size=200):
    common = round(2 * size * similarity / (1 + similarity))
    every = rng.integers(0, 1 << 64, 2 * size - common, dtype=np.uint64)
    return np.unique(every[:size]), np.unique(np.concatenate([every[:common], every[size:]]))


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_planted_pairs_share_a_band_and_are_estimated_well(spark, similarity):
    """All of 3000 planted pairs are candidates; estimates are right on average and none is below the bound."""
    rng = np.random.default_rng(7)
    left, right = (minima(list(x)) for x in zip(*[planted(rng, similarity) for _ in range(3000)]))
    assert (band_keys(left) == band_keys(right)).any(axis=1).all()
    rows = [(i, *x) for i, x in enumerate(zip(packed(left).tolist(), packed(right).tolist()))]
    found = spark.createDataFrame(rows, "i int, a array<long>, b array<long>").select(estimated(F.col("a"), F.col("b")).alias("e")).toPandas()["e"].to_numpy()
    exact = np.array([((x == y).mean()) for x, y in zip(left, right)])
    assert abs(found.mean() - similarity) < 0.005 and (found >= least_estimate(80)).all()
    assert (found >= exact - 1e-9).mean() < 0.75 and np.abs(found - exact).max() < 0.2  # chance is taken off again


def test_pairs_of_nothing_in_common_are_left_out(spark):
    rng = np.random.default_rng(8)
    left, right = (packed(minima([np.unique(rng.integers(0, 1 << 64, 100, dtype=np.uint64)) for _ in range(2000)])) for _ in range(2))
    found = spark.createDataFrame(list(zip(left.tolist(), right.tolist())), "a array<long>, b array<long>").select(estimated(F.col("a"), F.col("b")).alias("e")).toPandas()["e"]
    assert abs(found.mean()) < 0.01 and (found < least_estimate(80)).all()


def test_the_bound_is_passed_with_the_stated_probability():
    chance = 2.0**-BITS
    agree = chance + (1 - chance) * 0.8
    need = math.ceil((least_estimate(80) * (1 - chance) + chance) * MINIMA - 1e-9)
    missed = sum(math.comb(MINIMA, k) * agree**k * (1 - agree) ** (MINIMA - k) for k in range(need))
    assert missed < 1e-8 and (1 - 0.8**bbit_minhash.ROWS) ** bbit_minhash.BANDS < 5.1e-8


def test_a_filter_lets_every_key_through_and_few_others(spark):
    rng = np.random.default_rng(2)
    keys, others = rng.integers(-(1 << 63), (1 << 63) - 1, 5000), rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    held = Filter(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k")
    assert held.may_hold(keys).all() and held.may_hold(others).mean() < 0.1
    assert not Filter(spark.createDataFrame([], "k long"), "k").may_hold(others).any()


def test_links_of_one_set_with_many(spark, monkeypatch):
    """Parts of four sets each, every one with the set they are compared with; the exact bound is a link."""
    monkeypatch.setattr(bbit_minhash, "COMPARED", 4)
    base = list(range(100, 180))
    sets = [(0, base)] + [(i, sorted(base[:72] + list(range(1000 * i, 1000 * i + i % 20)))) for i in range(1, 60)]
    rows = spark.createDataFrame(sets, "sid long, set array<long>").repartition(3)
    pairs = spark.createDataFrame([(0, i) for i in range(1, 60)], "a long, b long")
    wanted = {(0, i) for i in range(1, 60) if 100 * 72 >= 80 * (80 + i % 20)}
    assert {tuple(r) for r in linked(pairs, rows, 80).collect()} == wanted and 0 < len(wanted) < 59


def test_signatures_of_equal_sets_are_equal(docs_of):
    a, b = sorted(signatures(docs_of([(1, "a b c d e a b c d e"), (2, "A B C D E a b c d  e")]), 4).collect())
    assert (a.sid, a.n, a.bands, a.bits) == (b.sid, b.n, b.bands, b.bits) and a.h != b.h


def test_heavy_keys_are_joined_by_broadcast(spark):
    rows = spark.createDataFrame([(i, i % 3 if i < 2000 else i) for i in range(5000)], "i int, k int")
    found = rows.groupBy("k").agg(F.count("*").alias("m"), F.min("i").alias("least"))
    joined = join_heavy(rows, found, "k", "m")
    assert joined.columns == ["i", "k", "least"] and joined.count() == 5000
    assert joined.where("least <> IF(i < 2000, i % 3, i)").count() == 0
