"""Language ID, LM scoring and toxicity: exact parts against brute force, learned parts on held-out rows."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from ringlake.llm import language_id, lm_scoring, toxicity
from ringlake.llm.common import labelled_sample

SYLLABLES = {"xx": ["ba", "bo", "ti", "ta"], "yy": ["kur", "vem", "zol", "ba"], "zz": ["да", "не", "то", "ки"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(rng, n=240):
    langs = sorted(SYLLABLES)
    return [(i, sentence(rng, langs[i % 3], rng.randint(5, 40)), langs[i % 3] if i % 7 else None, "s") for i in range(n)]


# language ID


def path_by_hand(scores, starts, penalty):
    out = []
    for a, b in zip(starts, starts[1:]):
        if a == b:
            continue
        v, back = scores[a].copy(), []
        for t in range(a + 1, b):
            best = v.argmax()
            come = np.where(v >= v[best] - penalty, np.arange(len(v)), best)
            back.append(come)
            v = v[come] - penalty * (come != np.arange(len(v))) + scores[t]
        path = [v.argmax()]
        for come in reversed(back):
            path.append(come[path[-1]])
        out += path[::-1]
    return np.array(out)


@pytest.mark.parametrize("lane", [1, 4, 128])
def test_viterbi_is_exact(lane):
    rng = np.random.default_rng(lane)
    starts = np.array([0, 0, 1, 9, 9, 300, 700, 700])
    scores = (rng.normal(size=(700, 5)) * 3).astype(np.float32)
    got = language_id.viterbi(scores, starts, 6.0, lane)
    assert (got == path_by_hand(scores, starts, 6.0)).all() and (np.diff(got) != 0).any()
    assert len(language_id.viterbi(scores[:0], np.array([0, 0]), 6.0)) == 0


def test_languages_of_held_out_rows(docs_of):
    docs = docs_of(corpus(random.Random(2)))
    model = language_id.train(docs)
    assert model.languages == ("xx", "yy", "zz")
    for r in language_id.predict(docs, model, carry=("doc_id", "text")).collect():
        assert r.lang_pred == sorted(SYLLABLES)[r.doc_id % 3] and 0.5 < r.score <= 1


def test_training_sees_no_held_out_row(docs_of):
    rows = corpus(random.Random(2))
    out = [r for r in rows if crc32(str(r[0]).encode()) % 4 == 2]
    changed = [(i, "totally else", "qq", "s") if (i, t, x, s) in out else (i, t, x, s) for i, t, x, s in rows]
    a, b = language_id.train(docs_of(rows)), language_id.train(docs_of(changed))
    assert out and a.languages == b.languages and (a.log_p == b.log_p).all()


def test_spans_of_a_mixed_text(docs_of):
    rng = random.Random(7)
    model = language_id.train(docs_of(corpus(rng)))
    text = sentence(rng, "xx", 30) + " " + sentence(rng, "yy", 20) + " " + sentence(rng, "zz", 10)
    r = language_id.predict(docs_of([(1, text)]), model, spans=True).collect()[0]
    assert [s.lang for s in r.spans] == ["xx", "yy", "zz"] and r.spans[0].first == 0 and r.spans[-1].last == 59
    assert abs(r.spans[0].last - 29) <= 1 and abs(r.spans[1].last - 49) <= 1
    assert r.lang_pred == "xx" and r.score == pytest.approx(0.5, abs=0.05)
    several = language_id.predict(docs_of([(1, None), (2, "ba kur"), (3, "12"), (4, text), (5, "ba")]), model, spans=True).collect()
    assert [[(s.first, s.last) for s in r.spans][-1:] for r in several] == [[], [(0, 1)], [], [(r.spans[-1].first, 59) for r in [several[3]]], [(0, 0)]]


def test_word_scores_and_score_against_a_loop(docs_of):
    """Log-probabilities of features added up word by word; score is the share of the language times its probability."""
    rng = random.Random(5)
    rows = corpus(rng)
    model = language_id.train(docs_of(rows))
    seen = {x: Counter() for x in model.languages}
    for i, t, x, _ in rows:
        if x and crc32(str(i).encode()) % 4 != 2:
            for w in language_id.words_of(t):
                seen[x].update(language_id.word_features([w])[0].tolist())
    size = 1 << language_id.BITS
    log_p = {x: lambda b, n=n: math.log((n[b] + 0.5) / (sum(n.values()) + 0.5 * size)) for x, n in seen.items()}
    latin = ["xx", "yy"]  # the languages whose training words are in Latin script

    def scores(w):
        return {x: sum(log_p[x](b) for b in language_id.word_features([w])[0].tolist()) / language_id.MAX_GRAM for x in latin}

    words = sentence(rng, "xx", 12).split() + sentence(rng, "yy", 5).split()
    got, known = model.score(words)
    assert known.all()
    for w, g in zip(words, got):
        s = scores(w)
        assert g[:2] == pytest.approx([s[x] - max(s.values()) for x in latin], abs=1e-3)
    r = language_id.predict(docs_of([(1, " ".join(words))]), model, penalty=0.0).collect()[0]
    best = [max(latin, key=scores(w).get) for w in words]
    total = {x: sum(scores(w)[x] for w, b in zip(words, best) if b == "xx") for x in latin}
    p = 1 / (1 + math.exp(total["yy"] - total["xx"]))
    assert r.lang_pred == "xx" and r.score == pytest.approx(best.count("xx") / len(words) * p, abs=1e-3)


def test_language_edge_cases(docs_of):
    model = language_id.train(docs_of(corpus(random.Random(2))))
    rows = [(1, None), (2, ""), (3, "12 -- 3!"), (4, "ქართული"), (5, "tibata " * 30_000), (None, "tibata"), (6, "tibata"), (6, "tibata"), (7, "b" * 50_000)]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(docs_of(rows), model).collect()]
    assert [x[1:] for x in got if x[0] in (1, 2, 3)] == [("und", 0.0)] * 3
    assert [x[1] in model.languages and x[2] for x in got if x[0] == 4] == [0.0]
    assert [x[1] for x in got if x[0] in (5, 6, None)] == ["xx"] * 4 and len(got) == 9
    kept = language_id.predict(docs_of(rows), model, carry=("doc_id",), min_score=0.3)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [5, 6, 6, 7]
    assert language_id.predict(docs_of([]), model).count() == 0
    nothing = language_id.train(docs_of([(1, "abc", None, None)]))
    assert [r.lang_pred for r in language_id.predict(docs_of([(1, "abc"), (2, None)]), nothing).collect()] == ["und"] * 2


# LM scoring


def losses_by_hand(texts, weights, text):
    """Mean loss of a text under counts of n-grams of characters, each text's counted ``weight`` times."""
    n = Counter()
    pad = ["^"] * (lm_scoring.ORDER - 1)
    for t, w in zip(texts, weights):
        s = pad + list(t)
        for i in range(len(pad), len(s)):
            for k in range(1, lm_scoring.ORDER + 1):
                n[k, tuple(s[i - k + 1 : i + 1])] += w
            if i == len(pad):
                for k in range(1, lm_scoring.ORDER):
                    n[k, tuple(pad[:k])] += w
    v = len({c for t in texts for c in t})
    total = sum(w * len(t) for t, w in zip(texts, weights))
    s, loss = pad + list(text), 0.0
    for i in range(len(pad), len(s)):
        p = (n[1, (s[i],)] + 1 / v) / (total + 1)
        for k in range(2, lm_scoring.ORDER + 1):
            p = (n[k, tuple(s[i - k + 1 : i + 1])] + lm_scoring.SMOOTHING * p) / (n[k - 1, tuple(s[i - k + 1 : i])] + lm_scoring.SMOOTHING)
        loss -= math.log(min(p, 1))
    return loss / max(len(text), 1)


def target_of(labels_of, ids):
    return labels_of([(i, 1, 0) for i in ids]).select("doc_id")


def without_own(texts, good, i):
    """(target loss, background loss) of text i by hand, under counts without its own, both of the target's size."""
    scale = sum(len(texts[j]) for j in good) / sum(map(len, texts))
    return losses_by_hand(texts, [j in good and j != i for j in range(len(texts))], texts[i]), losses_by_hand(texts, [(j != i) * scale for j in range(len(texts))], texts[i])


def test_losses_against_a_loop(docs_of, labels_of):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abé \n") for _ in range(rng.randint(1, 60))) for _ in range(25)] + ["", "zzz", "a"]
    rows = [(i, t or None) for i, t in enumerate(texts)]
    good = [i for i in range(len(texts)) if i % 3 == 0]
    found = lm_scoring.cross_entropy_difference(docs_of(rows), target_of(labels_of, [*good, *good, None, 999]))
    assert found.columns[:2] == ["doc_id", "score"]
    got = {r.doc_id: r for r in found.collect()}
    for i, t in enumerate(texts):
        assert (got[i].target_loss, got[i].background_loss) == pytest.approx(without_own(texts, good, i), abs=1e-9)
        assert got[i].n_tokens == len(t) and got[i].score == pytest.approx(got[i].background_loss - got[i].target_loss)


def test_score_does_not_tell_which_documents_the_target_model_counted(docs_of, labels_of):
    """Half of the good documents are in the target; they score like the other half, and both above the rest."""
    rng = random.Random(9)
    rows = [(i, sentence(rng, "xx" if i % 2 else "yy", 60)) for i in range(160)]
    target = [i for i, _ in rows if i % 4 == 1]
    got = {r.doc_id: r.score for r in lm_scoring.cross_entropy_difference(docs_of(rows), target_of(labels_of, target)).collect()}
    mean = lambda k: np.mean([got[i] for i in got if i % 4 == k])
    assert abs(mean(1) - mean(3)) < 0.02 and min(mean(1), mean(3)) > mean(0) + 0.2


def test_lm_edge_cases(docs_of, labels_of):
    rows = [(1, None), (2, ""), (3, "ab"), (3, "ab"), (None, "ab"), (4, "xy" * 300_000)]
    got = lm_scoring.cross_entropy_difference(docs_of(rows), target_of(labels_of, [])).collect()
    assert len(got) == 6 and all(r.score == 0 for r in got if r.doc_id in (1, 2)) and all(math.isfinite(r.score) for r in got)
    assert lm_scoring.cross_entropy_difference(docs_of([]), target_of(labels_of, [])).count() == 0


# toxicity


def toxic_corpus(rng, n=700):
    docs, marks = [], []
    for i in range(n):
        words = sentence(rng, "xx", rng.randint(20, 300)).split()
        bad = i % 5 == 2 or i % 5 == 4
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "grumf" + rng.choice(SYLLABLES["xx"]))
        docs.append((i, " ".join(words)))
        marks.append((i, None, int(bad)))
    return docs, marks


def test_toxicity_of_held_out_rows(docs_of, labels_of):
    docs, marks = toxic_corpus(random.Random(8))
    model = toxicity.train(docs_of(docs), labels_of(marks))
    label = {i: t for i, _, t in marks}
    got = [r for r in toxicity.predict(docs_of(docs), model).collect() if crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) > 50 and sum(r.predicted == label[r.doc_id] for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    # labels of held-out rows are never seen
    other = [(i, q, 1 - t if crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in marks]
    assert (toxicity.train(docs_of(docs), labels_of(other)).weights == model.weights).all()


def kneser_ney_by_hand(toxic, ordinary, word):
    """log p_toxic - log p_ordinary of a word and its end, by dicts of plain tuples."""
    order, shared, d = toxicity.ORDER, toxicity.SHARED_ORDER, toxicity.DISCOUNT

    def grams(w):
        s = [None] * (order - 2) + ["^", *w, "^"]
        return [tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s))]

    def counts(words):
        return Counter(g for w in words for g in grams(w))

    def shorter(n):
        return Counter(g[1:] for g in n)

    tables = [{order: counts(toxic)}, {order: counts(ordinary)}]
    for k in range(order - 1, 0, -1):
        if k >= shared:
            for t in tables:
                t[k] = shorter(t[k + 1])
        else:
            both = shorter(set(tables[0][k + 1]) | set(tables[1][k + 1]))
            tables[0][k] = tables[1][k] = both

    seen = len(tables[0][1])

    def p(t, g):
        if not g:
            return 1 / (seen + 1)
        own = {x: n for x, n in t[len(g)].items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        if not total:
            return p(t, g[1:])
        return max(own.get(g, 0) - d, 0) / total + sum(min(n, d) for n in own.values()) / total * p(t, g[1:])

    return sum(math.log(p(tables[0], g)) - math.log(p(tables[1], g)) for g in grams(word))


def fitted(toxic, ordinary):
    parts = [toxicity.ngrams(w)[0] for w in (toxic, ordinary)]
    mark = np.repeat([1, 0], [len(x) for x in parts])
    return toxicity.fit(np.concatenate(parts), mark, 1 - mark)


def test_kneser_ney_against_a_loop():
    """Each word's ratio is that of a loop over dicts, with characters far beyond any alphabet of a thousand."""
    rng = random.Random(21)
    letters = [chr(c) for c in rng.sample(range(0x4E00, 0x9FFF), 1500)]
    draw = lambda chars, n: ["".join(rng.choice(chars) for _ in range(rng.randint(1, 7))) for _ in range(n)]
    toxic, ordinary = draw("abc", 60) + draw(letters, 40) + ["grumf"] * 5, draw("abcd", 60) + draw(letters, 40)
    model = fitted(toxic, ordinary)
    words = ["abc", "grumf", "grumble", "zzz", "a", "😀", *toxic[:10], *toxic[60:70], *ordinary[60:70], letters[0] * 3]
    assert model.ratios(words) == pytest.approx([kneser_ney_by_hand(toxic, ordinary, w) for w in words], abs=1e-4)
    assert model.ratios(["grumf"])[0] > 3 and abs(model.ratios(["zzzzz"])[0]) < 1
    assert np.allclose(fitted(toxic, toxic).ratios(words), 0) and len(model.ratios([])) == 0


def test_features_against_a_loop():
    rng = random.Random(3)
    model = fitted(["grumf", "ab"] * 9, ["ba", "ab", "aa"] * 9)
    draw = ["ab", "ba", "aa", "grumf", "zz"]
    texts = [None, "", "1 2", *(" ".join(rng.choice(draw) for _ in range(rng.choice([1, 2, 31, 33, 200]))) for _ in range(12)), "", "ab"]
    got = toxicity.Scorer(model).features(texts)
    for t, x in zip(texts, got):
        w = (t or "").split() if t and t[0].isalpha() else []
        if not w:
            assert (x == 0).all()
            continue
        v = [float(model.ratios([a])[0]) for a in w]
        new = [a not in w[max(0, k - toxicity.WINDOW + 1) : k] for k, a in enumerate(w)]
        u = [p if n else 0.0 for p, n in zip(v, new)]
        top = sorted((max(0.0, p) for p in dict(zip(w, v)).values()), reverse=True)
        peak = max(sum(u[max(0, k - toxicity.WINDOW) : k]) / toxicity.WINDOW for k in range(1, len(u) + 1))
        assert x == pytest.approx([sum(u) / sum(new), peak, top[0], sum(top[:3]) / 3], abs=1e-5)


def test_sample_has_one_row_of_each_id(docs_of, labels_of):
    rows = [(1, "b"), (1, "a"), (1, None), (2, "x"), (None, "y")] * 50
    found = labelled_sample(docs_of(rows), labels_of([(1, 0, 1), (1, 0, 0), (2, 0, 0), (None, 0, 1)]), "toxic", 100, "s")
    assert sorted((r.doc_id, r.text, r.toxic) for r in found.collect()) == [(1, "a", 1), (2, "x", 0)]


def test_toxicity_edge_cases(docs_of, labels_of):
    docs, marks = toxic_corpus(random.Random(8), 200)
    model = toxicity.train(docs_of(docs), labels_of(marks + [(None, None, 1), (99_999, None, 1)]))
    rows = [(1, None), (2, ""), (3, "?!"), (4, "бла"), (5, "grumfba " * 40_000), (None, "grumfba"), (6, "a" * 60_000), (6, "a" * 60_000)]
    got = toxicity.predict(docs_of(rows), model).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.predict(docs_of([]), model).count() == 0
    blank = toxicity.train(docs_of(docs), labels_of([]))
    assert all(0 <= r.score <= 1 for r in toxicity.predict(docs_of(rows), blank).collect())


# rows that share an id


@pytest.mark.parametrize("shared", [None, 0, 1, 3])
def test_language_of_rows_that_share_an_id_is_learned(docs_of, shared):
    """Most rows of one language have one id, or none; it is learned all the same, from a bounded sample."""
    rng = random.Random(4)
    rows = [(10 + i, sentence(rng, "xx", 12), "xx", "s") for i in range(200)] + [(shared, sentence(rng, "yy", 12), "yy", "s") for _ in range(800)]
    docs = docs_of(rows)
    model = language_id.train(docs)
    assert model.languages == ("xx", "yy")
    found = language_id.predict(docs, model).collect()
    assert sum(r.lang_pred == "yy" for r in found if r.doc_id == shared) > 780 and sum(r.lang_pred == "xx" for r in found) > 190


def sampled(docs, monkeypatch, **options):
    """The texts of each language that a model is trained from."""
    seen = {}
    real = type(docs).mapInArrow

    def noting(self, *args, **kwargs):
        if self.columns == ["lang", "text"]:
            for r in self.collect():
                seen.setdefault(r.lang, []).append(r.text)
        return real(self, *args, **kwargs)

    monkeypatch.setattr(type(docs), "mapInArrow", noting)
    language_id.train(docs, **options)
    return seen


def test_the_sample_is_bounded_whatever_ids_are_shared(docs_of, monkeypatch):
    """Of 2000 rows of one id about 300 are in the sample; 500 copies of one row are one row of it."""
    rng = random.Random(5)
    same = sentence(rng, "zz", 9)
    rows = [(1, sentence(rng, "yy", 12), "yy", "s") for _ in range(2000)] + [(3, same, "zz", "s")] * 500 + [(100 + i, sentence(rng, "xx", 5), "xx", "s") for i in range(50)]
    seen = sampled(docs_of(rows), monkeypatch, per_language=300)
    assert 230 < len(seen["yy"]) < 370 and seen["zz"] == [same] and 25 < len(seen["xx"]) <= 50
