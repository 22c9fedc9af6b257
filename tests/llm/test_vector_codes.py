"""Product codes: trees against all distances, the whole operator against plain loops, and odd rows."""

from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ringlake.llm import vector_codes
from ringlake.llm.vector_codes import Tree, code_report, encode, train

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, salt int, own long"


@pytest.fixture
def vectors_of(spark):
    """A table of vectors from (vec_id, embedding, label), with extra columns of clashing names."""
    return lambda rows: spark.createDataFrame([(*r, "x", "y", 3, 4) for r in rows], SCHEMA)


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """{row place: (codes, error)} and the codebooks, by loops over all distances."""
    kept = [(i, r) for i, r in enumerate(rows) if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    ints = [[int(np.floor(scale * float(np.float32(x)))) for x in r[1]] for _, r in kept]
    each = len(ints[0]) // parts
    first = sorted(range(len(kept)), key=lambda j: (kept[j][1][0] is None, kept[j][1][0] or 0, ints[j]))[:entries]
    books = [[ints[j][p * each : (p + 1) * each] for j in first] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))

    def cut(v, p):
        return v[p * each : (p + 1) * each]

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in ints:
                groups.setdefault(nearest(cut(v, p), p)[1], []).append(cut(v, p))
            for k, g in groups.items():
                books[p][k] = [sum(x) // len(g) for x in zip(*g)]
    found = {i: [nearest(cut(v, p), p) for p in range(parts)] for (i, _), v in zip(kept, ints)}
    text = ",".join(str(x) for b in books for e in b for x in e)
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in found.items()}, sha256(text.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 90), st.integers(0, 3), st.integers(0, 10_000))
def test_the_tree_finds_the_nearest_entry_and_of_ties_the_first(width, n, spread, seed):
    rng = np.random.default_rng(seed)
    entries, queries = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread - 1, spread + 2, (70, width))
    d = ((queries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    at, best = Tree(entries).nearest(queries)
    assert at.tolist() == d.argmin(axis=1).tolist() and best.tolist() == d.min(axis=1).tolist()


@pytest.mark.parametrize("size", [1, 1 << 20, 1 << 27])
def test_large_numbers_stay_exact(size):
    rng = np.random.default_rng(size)
    entries, queries = (rng.integers(-size, size + 1, (200, 4)) for _ in range(2))
    d = ((queries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    at, best = Tree(entries).nearest(queries)
    assert at.tolist() == d.argmin(axis=1).tolist() and best.tolist() == d.min(axis=1).tolist()


def test_nothing_to_search():
    at, best = Tree(np.arange(8).reshape(4, 2)).nearest(np.zeros((0, 2), dtype=np.int64))
    assert len(at) == len(best) == 0


def test_the_report_is_that_of_plain_loops(vectors_of):
    """Clusters with ties and copies, a label of a third of all rows, labels of null, and rows that take no part."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-3, 4, 8) / 64).tolist(), None if i % 7 == 0 else 1 if i % 3 == 0 else i % 5) for i in range(600)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(40)] + [(7, rows[9][1], 2)]
    rows += [(2000, None, 1), (2001, [None] * 8, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] + [0.0] * 7, 1), (2004, [0.5], 1), (2005, [], 1)]
    wanted, digest = plain([r for r in rows if r[1] is None or len(r[1]) == 8])
    found = code_report(vectors_of(rows)).collect()
    labels = {}
    for i, (_, error) in wanted.items():
        labels[rows[i][2]] = labels.get(rows[i][2], 0) + error
    key = lambda r: (r[0], r[1], r[2], r[3])
    assert sorted(map(key, found)) == sorted((rows[i][0], code, error, labels[rows[i][2]]) for i, (code, error) in wanted.items())
    assert {r.codebooks_sha256 for r in found} == {digest}


def test_few_vectors_null_ids_and_parts(vectors_of):
    rows = [(None, [0.1, 0.2, 0.3, 0.4], 1), (3, [0.4, 0.1, 0.0, 0.2], None), (1, [0.0, 0.0, 0.0, 0.0], 1), (1, [-0.5, 0.0, 0.0, 0.0], 1)]
    wanted, digest = plain(rows)
    found = code_report(vectors_of(rows)).collect()
    assert sorted((r.code, r.error) for r in found) == sorted(wanted.values()) and found[0].codebooks_sha256 == digest
    books = train(vectors_of(rows), parts=2, rounds=0)
    assert books.tables[0][0].tolist() == [-512, 0] and books.tables[0][3].tolist() == [102, 204]  # the lesser vector first, the null id last
    coded = {r.vec_id: r for r in encode(vectors_of(rows), books).collect()}
    assert books.decode(coded[3].codes).tolist() == [409, 102, 0, 204] and coded[3].error == 0
    with pytest.raises(ValueError):
        train(vectors_of(rows), parts=3)


def test_nothing_whole_gives_no_rows(vectors_of):
    for rows in ([], [(1, None, 1), (2, [float("nan")], 1), (3, [], 0)]):
        report = code_report(vectors_of(rows))
        assert report.collect() == [] and report.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_numbers_beyond_64_bits_take_no_part(vectors_of):
    rows = [(1, [3e38, 0.0, 0.0, 0.0], 1), (2, [0.5, 0.0, 0.0, 0.0], 1)]
    assert [r.vec_id for r in code_report(vectors_of(rows)).collect()] == [2]


def test_one_tree_goes_out_for_each_codebook(vectors_of):
    books = train(vectors_of([(i, [i / 7, i / 5, -i / 3, 0.0], 0) for i in range(50)]), parts=2, rounds=1)
    assert len(books.trees()) == 2 and all(len(t.nodes) > 1 for t in books.trees())
    assert vector_codes.Tree(books.tables[0]).nearest(books.tables[0])[1].max() == 0
