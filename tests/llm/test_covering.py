"""Sequential covering against plain loops over the rows: the same thresholds, literals, pruning and ends."""

import math
import random

import pytest

from ringlake.llm.quality_rules import FEATURES, Literal, learn_rules

NAMES = list(FEATURES)
COLUMNS = ("n_symbols", "n_words", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "word_chars", "n_marks")


def values(row):
    d = dict(zip(COLUMNS, row[:8]))
    one = lambda x: max(x, 1)
    return {
        "symbols_per_word": d["n_symbols"] / one(d["n_words"]), "dup_lines_per_line": d["n_dup_lines"] / one(d["n_lines"]), "repeat_share": d["n_repeat_words"] / one(d["n_words"]), "upper_share": d["n_upper"] / one(d["word_chars"]),
        "marks_per_word": d["n_marks"] / one(d["n_words"]), "word_length": d["word_chars"] / one(d["n_words"]), "words_per_line": d["n_words"] / one(d["n_lines"]), "words": float(d["n_words"]),
    }


def quantiles(xs, bins):
    xs = sorted(xs)
    return {float(f"{xs[max(math.ceil(len(xs) * i / bins) - 1, 0)]:.4g}") for i in range(1, bins)} if xs else set()


def holds(rule, v):
    return all((v[x.feature] > x.threshold) == x.above for x in rule)


def cover(rows, max_rules=6, max_literals=3, bins=32, precision=0.9, least=5, slack=0.1):
    """Rules by loops over rows (feature values, bad, grow)."""
    cuts = {f: sorted(quantiles([v[f] for v, bad, _ in rows if bad], bins) | quantiles([v[f] for v, bad, _ in rows if not bad], bins)) for f in NAMES}
    rules = []
    while len(rules) < max_rules:
        left = [r for r in rows if not any(holds(q, r[0]) for q in rules)]
        rule = ()
        while len(rule) < max_literals:
            seen = [r for r in left if r[2] and holds(rule, r[0])]
            p0 = sum(r[1] for r in seen)
            gains = {}
            for f in NAMES:
                for t in cuts[f]:
                    for above in (False, True):
                        some = [r for r in seen if (r[0][f] > t) == above]
                        p = sum(r[1] for r in some)
                        if p >= least:
                            gains.setdefault((f, above), []).append((p * (math.log2(p / len(some)) - (math.log2(p0 / len(seen)) if p0 else 0.0)), t, len(some) - p))
            if not gains:
                break
            key = max(gains, key=lambda k: (max(gains[k])[0], k))
            top = max(gains[key])[0]
            if top <= 1e-6:
                break
            near = sorted((t, n) for g, t, n in gains[key] if g >= (1 - slack) * top)
            t, n = near[len(near) // 2]
            rule = (*rule, Literal(key[0], key[1], t))
            if n == 0:
                break
        if not rule:
            break
        others = [r for r in left if not r[2]]
        best = None
        for i in range(1, len(rule) + 1):  # the shortest of the best
            p = sum(r[1] for r in others if holds(rule[:i], r[0]))
            n = sum(1 - r[1] for r in others if holds(rule[:i], r[0]))
            score = (p - n) / (p + n) if p + n else -1.0
            if best is None or score > best[0]:
                best = score, i, p, n
        _, i, p, n = best
        if p < max(1, least // 2) or p < precision * (p + n):
            break
        rules.append(rule[:i])
    return rules


def labelled(seed, n=700):
    """Bad rows by two planted conjunctions, and some of each label by chance."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words, lines = rng.randint(20, 90), rng.randint(1, 9)
        row = [rng.randint(0, 40), words, rng.randint(0, lines), lines, rng.randint(0, words // 3), rng.randint(0, 60), words * rng.randint(3, 9), rng.randint(0, 30)]
        bad = (row[0] > 25 and words < 60) or (row[7] > 22 and row[5] > 30)
        out.append((*row, int(bad and rng.random() < 0.97), i % 3 != 0))
    return out


@pytest.mark.parametrize("seed", [1, 3])
def test_rules_are_those_of_loops(spark, seed):
    rows = labelled(seed)
    schema = ", ".join(f"{c} long" for c in COLUMNS) + ", bad int, grow boolean"
    lengths = []
    for options in ({}, {"max_literals": 2, "precision": 0.6, "bins": 8}):
        wanted = cover([(values(r), r[8], r[9]) for r in rows], **options)
        assert learn_rules(spark.createDataFrame(rows, schema), **options) == wanted
        lengths += [len(rule) for rule in wanted]
    assert lengths and max(lengths) > 1


def test_without_bad_rows_there_are_no_rules(spark):
    rows = [(*r[:8], 0, r[9]) for r in labelled(4, 60)]
    schema = ", ".join(f"{c} long" for c in COLUMNS) + ", bad int, grow boolean"
    assert learn_rules(spark.createDataFrame(rows, schema)) == [] == cover([(values(r), 0, r[9]) for r in rows])
