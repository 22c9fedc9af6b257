"""Chat formatting, mixing and quality rules against brute force, and their edge cases."""

import random
import re
from collections import Counter, defaultdict
from hashlib import md5

import pytest

from ringlake.llm import chat_format, quality_rules, source_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# chat formatting

TURNS = "conv_id long, turn long, role string, text string, pair_id long, c string"


def examples(spark, rows, pairs):
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    return {r.pair_id: r for r in chat_format.preference_examples(turns, spark.createDataFrame(pairs, "pair_id long, chosen_id long, rejected_id long")).collect()}


def test_common_prefix_is_rendered_once(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", "hi"), (2, 1, "assistant", "bad"), (2, 2, "user", "why")]
    e = examples(spark, rows, [(7, 1, 2)])[7]
    assert e.prompt == "<|im_start|>user\nhi<|im_end|>\n" and e.n_prefix == 1
    assert e.chosen == "<|im_start|>assistant\ngood<|im_end|>\n"
    a, b = map(int, e.chosen_spans.split("-"))
    assert e.chosen[a:b] == "good<|im_end|>\n"
    assert e.rejected.endswith("<|im_start|>user\nwhy<|im_end|>\n")
    a, b = map(int, e.rejected_spans.split("-"))
    assert e.rejected[a:b] == "bad<|im_end|>\n"


def test_chat_edge_cases(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, "user", "a"), (2, 1, "assistant", None),  # equal, null text
        (3, 0, "user", "a"), (4, 0, "user", "a"), (4, 1, "assistant", "ß日"),  # one begins the other
        (5, 0, None, "n"), (6, None, None, "n"), (6, 5, "user", ""), (None, 0, "user", "lost"),
        (8, 0, "user", "t"), (8, 0, "user", "t"), (9, 0, "user", "t"),  # repeated turn
    ]
    e = examples(spark, rows, [(1, 1, 2), (2, 3, 4), (3, 5, 6), (4, 8, 9), (5, 1, 77), (6, None, 1)])
    assert set(e) == {1, 2, 3, 4}
    assert (e[1].n_prefix, e[1].chosen, e[1].rejected, e[1].chosen_spans) == (2, "", "", "")
    assert e[2].chosen == "" and e[2].rejected_spans == "22-35"
    assert e[3].n_prefix == 1 and "unknown\nn" in e[3].prompt
    assert e[4].n_prefix == 1 and e[4].rejected == "" and e[4].chosen.count("t<|im_end|>") == 1


def test_chat_empty_table(spark):
    assert examples(spark, [], []) == {}
    assert chat_format.swapped_replies(spark.createDataFrame([], TURNS)).count() == 0


def test_neighbours_of_large_ids(spark):
    rows = [(2**60 + 2, 0, "user", "a"), (2**60 + 3, 0, "user", "a"), (-1, 0, "user", "b"), (-2, 0, "user", "b"), (None, 0, "user", "c")]
    pairs = chat_format.neighbour_pairs(spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS))
    assert sorted(tuple(r) for r in pairs.collect()) == [(-1, -2, -1), (2**59 + 1, 2**60 + 2, 2**60 + 3)]


def swapped_by_hand(rows):
    """(prompt, chosen, rejected) of each conversation by plain loops."""
    first = lambda x: (x is not None, x if x is not None else 0)
    text = lambda x: (x is not None, x or "")
    own = defaultdict(list)
    for i, *t in rows:
        if i is not None:
            own[i].append(tuple(t))
    for t in own.values():
        t.sort(key=lambda x: (first(x[0]), text(x[1]), text(x[2])))
    reply = {i: [k for k, x in enumerate(t) if x[1] == "assistant"][-1:] for i, t in own.items()}
    out = {}
    for i, t in own.items():
        if not reply[i]:
            continue
        stop = reply[i][0]
        partner = own.get(i ^ 1, [])
        other = partner[reply[i ^ 1][0]][2] if partner and reply[i ^ 1] else ""
        c, r = [x[1:] for x in t[: stop + 1]], [x[1:] for x in t[:stop]] + [("assistant", other or "")]
        n = next((k for k, (x, y) in enumerate(zip(c, r)) if x != y), len(c))
        render = lambda turns: "".join(f"<|im_start|>{a or 'unknown'}\n{b or ''}<|im_end|>\n" for a, b in turns)
        out[i] = (n, render(c[:n]), render(c[n:]), render(r[n:]))
    return out


def test_swapped_replies_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(rng.choice([*range(40), 2**60, None]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", None, "system"]), rng.choice([None, "", "a", "日b", "c"])) for _ in range(200)]
    rows += rows[:5]
    got = chat_format.swapped_replies(spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)).collect()
    assert {r.pair_id: (r.n_prefix, r.prompt, r.chosen, r.rejected) for r in got} == swapped_by_hand(rows) and len(got) > 20


# mixing


def mix_by_hand(rows, seed=17):
    """Virtual finish times by one loop over everything."""
    sizes = [(i, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    names = sorted({s for _, s, _ in sizes if s is not None}) + ([None] if any(s is None for _, s, _ in sizes) else [])
    total, own = sum(n for *_, n in sizes), Counter()
    for _, s, n in sizes:
        own[s] += n
    target, open_, left = {}, list(names), total
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * own[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * own[s]
            left -= 3 * own[s]
            open_.remove(s)
    queue = []
    for s in names:
        at = 0
        for key, i, n in sorted((int(md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:15], 16), -(2**63) if i is None else i, n) for i, x, n in sizes if x == s):
            at += n
            queue += [((at + c * own[s]) / target[s], names.index(s), key, i, n, c) for c in range(3) if n]
    taken, used = defaultdict(int), 0
    for _, k, _, i, n, _ in sorted(queue):
        used += n
        if used > total:
            break
        taken[names[k], i] += n
    return target, taken


@pytest.mark.parametrize("seed", range(3))
def test_mixing_against_a_loop(spark, docs_of, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 200])), None, rng.choice(["a", "b", "b", "b", "b", "ü", "z", None])) for i in range(300)]
    found = source_mixing.mix(docs_of(rows)).collect()
    target, taken = mix_by_hand([(i, t, s) for i, t, _, s in rows])
    source = {i: s for i, _, _, s in rows}
    assert len(found) == 300
    for r in found:
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert r.taken == taken[source[r.doc_id], r.doc_id] <= 3 * r.size
    for s, t in target.items():
        assert abs(sum(v for (x, _), v in taken.items() if x == s) - t) <= 400


def test_mixing_edge_cases(docs_of):
    assert source_mixing.mix(docs_of([])).count() == 0
    empty = source_mixing.mix(docs_of([(1, None, None, "a"), (2, " \n", None, None)])).collect()
    assert [(r.size, r.taken, r.target) for r in empty] == [(0, 0, 0.0)] * 2
    rows = [(None, "x y", None, "a"), (None, "x y", None, "a"), (3, "x y", None, "a"), (3, "x y", None, "a")]
    same = source_mixing.mix(docs_of(rows)).collect()
    assert len(same) == 4 and sum(r.taken for r in same) == 8


def test_mixed_documents_repeat(docs_of):
    rows = [(i, "one two three", None, "big") for i in range(30)] + [(100 + i, "one two three", None, "tiny") for i in range(2)]
    mixed = source_mixing.mixed_documents(docs_of(rows)).collect()
    n = Counter(r.doc_id for r in mixed)
    assert n[100] == n[101] == 3 and all(n[i] <= 1 for i in range(30))
    assert sum(n.values()) == 32


# quality rules


def by_hand(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics_against_a_loop(docs_of):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a b c d e f g h", "x\x1cy z  ", "日本 é😀 #|", "a\n\na\n \na"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "d# ", "\n", "  "]) for _ in range(rng.randint(1, 120))) for _ in range(120)]
    texts += [" ".join(str(i % 50) for i in range(20_000)), "w" * 100_000]
    rows = list(enumerate(texts))
    found = {r.doc_id: r for r in quality_rules.text_statistics(docs_of(rows)).collect()}
    for i, t in rows:
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == by_hand(t), repr(t)[:60]


def test_decision_list_finds_a_planted_rule(docs_of, labels_of):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, " ".join(rng.choice(words) + ("%%" if bad and rng.random() < 0.8 else "") + str(rng.randint(0, 999)) for _ in range(40))))
        if i % 2 == 0:
            marks.append((i, 0 if bad else 1, 0))
    found = quality_rules.quality(docs_of(rows), labels_of(marks)).collect()
    assert all(r.kept for r in found if r.doc_id % 4)
    assert sum(not r.kept for r in found if r.doc_id % 4 == 0) >= 0.9 * 150
    kept = quality_rules.quality_filter(docs_of(rows), labels_of(marks))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in found if r.kept) and kept.columns == docs_of([]).columns


def test_quality_edge_cases(docs_of, labels_of):
    found = quality_rules.quality(docs_of([(None, None), (1, ""), (1, ""), (2, " ".join(map(str, range(30))))]), labels_of([])).collect()
    assert sorted((str(r.doc_id), r.base_failed, r.kept, r.rule) for r in found) == [("1", True, False, 0)] * 2 + [("2", False, True, 0), ("None", True, False, 0)]
    assert quality_rules.quality(docs_of([]), labels_of([(None, None, None)])).count() == 0
