"""Hard negatives: the operator against plain loops, its bounds against exact scores, and odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ringlake.llm import hard_negatives
from ringlake.llm.hard_negatives import Anchors, Batch, Best, add_negatives, add_positives, mine, mined, window_of
from ringlake.llm.vector_codes import Codebooks, Tree, bytes_rows

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score long, block string"


@pytest.fixture
def vectors_of(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, 2, "z") for r in rows], SCHEMA)


def plain(rows, every, positives=5, negatives=10):
    """The result by loops over all pairs, in sorted order."""
    kept = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, lab, v in kept:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in kept if i != a or other != lab]
        for p, i, _ in sorted(s for s in scored if s[2] == lab and s[1] != a)[:positives]:
            hard = sorted(s for s in scored if s[2] != lab and 30 * -p <= 100 * -s[0] <= 90 * -p)[:negatives]
            out += [(a, i, k, n, -p, -s) for k, (s, n, _) in enumerate(hard, 1)]
    return sorted(out)


def clustered(n, width=8, seed=1):
    """Vectors around a few centres, a label of over a third of the rows, ties and copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    return [(i, (np.round((centres[i % 5] + rng.normal(size=width) / 2) * 8) / 64).tolist(), 0 if i % 5 < 2 else i % 5) for i in range(n)]


@pytest.mark.parametrize("block", [3, 16_384])
def test_the_result_is_that_of_plain_loops(vectors_of, block):
    rows = clustered(700) + [(2000 + i, clustered(1)[0][1], 4) for i in range(30)]
    rows += [(3000, None, 1), (3010, [None] * 8, 1), (3020, [float("nan")] * 8, 1), (3030, [float("-inf")] + [0.0] * 7, 1), (3040, [0.5], 1), (3050, [], 1), (3060, [0.5] * 8, None), (None, [0.5] * 8, 1)]
    found = mine(vectors_of(rows).repartition(5), F.col("vec_id") % 70 == 0, block=block)
    assert found.columns == [c.split()[0] for c in hard_negatives.RESULT.split(", ")]
    wanted = plain([r for r in rows if r[1] is None or len(r[1]) == 8], 70)
    assert len(wanted) > 100 and sorted(map(tuple, found.collect())) == wanted


def test_labels_move_where_ids_are_divisible_by_seven(vectors_of):
    rows = clustered(300)
    moved = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows]
    assert sorted(map(tuple, mined(vectors_of(rows)).collect())) == plain(moved, 100)


def test_few_rows_and_scores_without_a_window(vectors_of):
    """Two positives are all there are; one has a negative score and so no window, another a score of 0 and the window 0."""
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, -1.0], 2), (4, [0.0, 0.5], 2), (5, [0.5, 0.0], 2)]
    found = sorted(map(tuple, mine(vectors_of(rows), F.col("vec_id") == 0).collect()))
    assert found == [(0, 2, 1, 3, 0, 0), (0, 2, 2, 4, 0, 0)] == plain(rows, 100)


def test_repeated_rows_and_ids(vectors_of):
    """Rows under the anchor's own id are no positives; repeated rows are ranked one after the other."""
    v, w = [0.5, 0.25], [0.25, 0.25]
    found = mine(vectors_of([(0, v, 1), (0, v, 1), (1, v, 1), (2, w, 2), (2, w, 2)]), F.col("vec_id") == 0).collect()
    assert sorted({(r.anchor_id, r.positive_id) for r in found}) == [(0, 1)]
    assert sorted(r.rank for r in found if r.negative_id == 2) == [1, 1, 2, 2]  # for each of the two anchors


def test_nothing_to_mine(vectors_of):
    for rows in ([], [(0, None, 1)], [(0, [0.5, 0.5], None)], [(0, [0.5, 0.5], 1)], [(1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)]):
        found = mine(vectors_of(rows), F.col("vec_id") == 0)
        assert found.collect() == [] and len(found.columns) == 6


@pytest.mark.parametrize("score", [-7, 0, 1, 9, 10, 12345])
def test_windows_are_whole_numbers(score):
    low, high = window_of(score, 30, 90)
    assert [s for s in range(-20, 12400) if 30 * score <= 100 * s <= 90 * score] == list(range(low, high + 1))


def coded(rng, n, books):
    numbers = rng.integers(-300, 300, (n, 8)).astype(np.int32)
    found = [Tree(t).nearest(numbers[:, 2 * p : 2 * p + 2]) for p, t in enumerate(books.tables)]
    codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
    columns = [pa.array(np.arange(n)), pa.array(rng.integers(0, 3, n)), bytes_rows(numbers), bytes_rows(codes), pa.array(sum(d for _, d in found))]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "vector", "codes", "residual"]), numbers


def test_bounds_hold_and_leave_most_rows_out():
    rng = np.random.default_rng(3)
    books = Codebooks(tuple(rng.integers(-300, 300, (200, 2)) for _ in range(4)), 8, 256)
    batch, numbers = coded(rng, 3000, books)
    held, anchors = Batch(batch, books), Anchors(pa.Table.from_batches([batch.slice(0, 20)]), books)
    for a in range(20):
        exact = held.numbers @ numbers[a].astype(np.int64)
        least, most = held.bounds(anchors.table(a), anchors.norms[a], slice(None))
        assert (least <= exact).all() and (exact <= most).all()
        assert (most >= np.sort(least)[-5]).mean() < 0.2  # what is left to score exactly


def test_lists_are_the_same_however_rows_are_cut():
    """Ties at the last place included: what a bound leaves out never matters."""
    rng = np.random.default_rng(4)
    books = Codebooks(tuple(rng.integers(-300, 300, (60, 2)) for _ in range(4)), 8, 256)
    batch, _ = coded(rng, 900, books)
    anchors = Anchors(pa.Table.from_batches([batch.slice(0, 9)]), books)
    results = []
    for step in (900, 250, 1):
        best = [Best(5) for _ in range(9)]
        windows = {a: {w: (w * 10_000, w * 40_000, Best(4)) for w in (1, 3)} for a in range(9)}
        for i in range(0, 900, step):
            held = Batch(batch.slice(i, step), books)
            add_positives(held, anchors, best, 5)
            add_negatives(held, anchors, windows, 4)
        results.append(([(b.scores.tolist(), b.ids.tolist()) for b in best], [(w[2].scores.tolist(), w[2].ids.tolist()) for own in windows.values() for w in own.values()]))
    assert results[0] == results[1] == results[2]
