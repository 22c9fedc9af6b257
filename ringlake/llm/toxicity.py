"""Toxicity: class-conditional Kneser-Ney models of the characters of words, with shared backoff counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlake.llm.common import checkpoint, crc_mod, labelled_sample, map_texts, slices, starts_of

TOKENS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
WINDOW = 32
CALIBRATION_FOLD = 4
CACHE = 300_000

#: An n-gram holds ORDER symbols; below SHARED_ORDER classes share all counts.
ORDER, SHARED_ORDER = 6, 4
#: A symbol is a code point and 2, so that every character is its own; 3 of them fill each of a gram's two numbers.
SYMBOL_BITS, HALF = 21, 3
#: Absolute discount: what a class must have seen beyond this count to depart from the backoff.
DISCOUNT = 1.5
PAD, EDGE = 0, 1


def fold(doc_id: Column) -> Column:
    return crc_mod(doc_id, 5)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels training never sees."""
    return fold(doc_id) == 0


def words_of(text: str | None) -> list[str]:
    return TOKENS.findall(text.lower()) if text else []


def ngrams(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, word number): for each character of each word and its end, that and the ORDER - 1 symbols before it.

    A gram is a row of two numbers, the earlier HALF symbols and the later ones. Before a
    word stand an edge and padding.
    """
    codes = np.frombuffer((" ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - begin[owner]
    symbols = codes.astype(np.int64) + 2
    symbols[begin + lengths - 1] = EDGE
    grams = np.zeros((len(codes), 2), dtype=np.int64)
    for back in range(ORDER - 1, -1, -1):
        inside = np.where(place >= back, symbols[np.maximum(np.arange(len(codes)) - back, 0)], np.where(place == back - 1, EDGE, PAD))
        half = 0 if back >= HALF else 1
        grams[:, half] = (grams[:, half] << SYMBOL_BITS) | inside
    return grams, owner


def suffix(grams: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols of each gram."""
    keep = [(1 << (min(max(n, 0), HALF) * SYMBOL_BITS)) - 1 for n in (order - HALF, order)]
    return grams & np.array(keep, dtype=np.int64)


def context(grams: np.ndarray) -> np.ndarray:
    """All but the last symbol of each gram."""
    carried = (grams[:, 0] & ((1 << SYMBOL_BITS) - 1)) << ((HALF - 1) * SYMBOL_BITS)
    return np.column_stack([grams[:, 0] >> SYMBOL_BITS, carried | (grams[:, 1] >> SYMBOL_BITS)])


def keys_of(grams: np.ndarray) -> np.ndarray:
    """A 64-bit key of each gram. Among n grams two share one with probability about n^2 / 2^65: 3e-6 for ten million."""
    early, late = grams.astype(np.uint64).T
    h = (early ^ (early >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29)) ^ late) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, grams, group): the distinct grams by ascending key, and the number of each row's gram."""
    keys, first, group = np.unique(keys_of(grams), return_index=True, return_inverse=True)
    return keys, grams[first], group


@dataclass(frozen=True)
class Level:
    """Log-ratios toxic : ordinary of the n-grams of one order, and of the backoff weights of their contexts."""

    keys: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))
    return at, sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), dtype=bool)


@dataclass(frozen=True)
class KneserNey:
    """Two interpolated Kneser-Ney character models of words, as log-ratios toxic : ordinary.

    log p(c | context) of a class is log((n - D) / N + b q) for a gram that it knows and
    log(b q) otherwise, q being its estimate one order lower, from continuation counts: in
    how many ways a shorter gram is extended to the left. Below SHARED_ORDER both classes
    have the same counts, those of all texts, so a word that no class knows has ratio near 0.
    """

    levels: tuple[Level, ...]  # from ORDER down to SHARED_ORDER

    def ratios(self, words: Sequence[str]) -> np.ndarray:
        """Log-ratio of each word: the sum over its characters and its end."""
        if not len(words):
            return np.zeros(0)
        grams, owner = ngrams(words)
        out = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        for order, level in zip(range(ORDER, SHARED_ORDER - 1, -1), self.levels):
            g = suffix(grams[open_], order)
            at, known = _find(level.keys, keys_of(g))
            out[open_[known]] += level.ratio[at[known]]
            open_, g = open_[~known], g[~known]
            at, known = _find(level.contexts, keys_of(context(g)))
            out[open_[known]] += level.backoff[at[known]]
        return np.bincount(owner, weights=out, minlength=len(words))


def fit(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> KneserNey:
    """The models from the counts of distinct grams of ORDER symbols by class."""
    keys, grams, group = _distinct(grams)
    counts = {ORDER: (keys, grams, *(np.bincount(group, weights=n, minlength=len(keys)) for n in (toxic, ordinary)))}
    for order in range(ORDER - 1, 0, -1):
        _, above, t, o = counts[order + 1]
        keys, short, at = _distinct(suffix(above, order))
        pooled = np.bincount(at, minlength=len(keys)).astype(np.float64)
        own = [np.bincount(at, weights=n > 0, minlength=len(keys)) for n in (t, o)]
        counts[order] = (keys, short, *(own if order >= SHARED_ORDER else (pooled, pooled)))
    uniform = 1.0 / (len(counts[1][0]) + 1)  # the symbols seen, and one for all others
    levels = []
    below: tuple[np.ndarray, list[np.ndarray]] | None = None
    for order in range(1, ORDER + 1):
        keys, grams, *classes = counts[order]
        contexts, _, at = _distinct(context(grams))
        shorter = None if below is None else np.searchsorted(below[0], keys_of(suffix(grams, order - 1)))
        estimates, weights = [], []
        for c, n in enumerate(classes):
            total = np.bincount(at, weights=n, minlength=len(contexts))
            held = np.bincount(at, weights=np.minimum(n, DISCOUNT), minlength=len(contexts))
            b = np.where(total > 0, held / np.maximum(total, 1), 1.0)
            q = uniform if below is None else below[1][c][shorter]
            estimates.append(np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[at] + b[at] * q)
            weights.append(b)
        below = (keys, estimates)
        if order >= SHARED_ORDER:
            ratio, backoff = (np.log(x[0]) - np.log(x[1]) for x in (estimates, weights))
            levels.append(Level(keys, ratio.astype(np.float32), contexts, backoff.astype(np.float32)))
    return KneserNey(tuple(reversed(levels)))


FEATURES = 4


class Scorer:
    """Features of texts under a model; ratios of words are kept between slices, CACHE words at most."""

    def __init__(self, model: KneserNey):
        self.model, self.known, self.values = model, {}, np.zeros(0)

    def ratios(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number, ratio) of each word; equal words have equal numbers within a call."""
        if len(self.known) > CACHE:
            self.known, self.values = {}, np.zeros(0)
        missing = list(dict.fromkeys(w for w in words if w not in self.known))
        parts = [self.model.ratios(missing[a : a + 50_000]) for a in range(0, len(missing), 50_000)]
        self.known.update(zip(missing, range(len(self.known), len(self.known) + len(missing))))
        self.values = np.concatenate([self.values, *parts])
        number = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        return number, self.values[number]

    def features(self, texts: Sequence[str | None]) -> np.ndarray:
        """FEATURES numbers a text, zeros without words: mean log-ratio of the words, largest sum over WINDOW words in
        a row / WINDOW, log-ratio of the most toxic word, and mean of the three most toxic ones.

        A word that comes again within WINDOW words counts once for the first two, so that
        a phrase repeated many times is no evidence.
        """
        lists = [words_of(t) for t in texts]
        starts = starts_of([len(x) for x in lists])
        number, ratio = self.ratios([w for x in lists for w in x])
        out = np.zeros((len(texts), FEATURES))
        if not len(ratio):
            return out
        counts = np.diff(starts)
        full = counts > 0
        begins = starts[:-1][full]
        owner = np.repeat(np.arange(len(texts)), counts)
        key = owner * (int(number.max()) + 1) + number
        order = np.argsort(key, kind="stable")
        same = np.append(False, key[order][1:] == key[order][:-1])
        again = order[same & (np.diff(order, prepend=0) < WINDOW)]
        fresh = np.ones(len(ratio))
        fresh[again] = 0
        total = np.concatenate([[0.0], np.cumsum(ratio * fresh)])
        out[full, 0] = (total[starts[1:]] - total[starts[:-1]])[full] / np.add.reduceat(fresh, begins)
        # a window for each word: the WINDOW words up to it, fewer at the start of a text
        end = np.arange(1, len(total))
        out[full, 1] = np.maximum.reduceat((total[end] - total[np.maximum(end - WINDOW, starts[owner])]) / WINDOW, begins)
        distinct = order[~same]
        distinct = distinct[np.lexsort((-ratio[distinct], owner[distinct]))]
        heads = np.searchsorted(owner[distinct], np.flatnonzero(full))
        place = np.arange(len(distinct)) - np.repeat(heads, np.diff(np.append(heads, len(distinct))))
        above = np.maximum(ratio[distinct], 0)
        out[full, 2] = above[heads]
        out[:, 3] = np.bincount(owner[distinct], weights=above * (place < 3), minlength=len(texts)) / 3
        return out


@dataclass(frozen=True)
class ToxicityModel:
    words: KneserNey
    weights: np.ndarray  # of the features, then the constant

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; classes count equally."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    balance = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    ridge = np.array([1.0] * x.shape[1] + [0.0])
    b = np.zeros(len(ridge))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (balance * (p - y)) + ridge * b
        hess = (z * (balance * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge + 1e-6)
        b = b - np.linalg.solve(hess, g)
    w = b[:-1] / scale
    return np.array([*w, b[-1] - w @ mean])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 6000) -> ToxicityModel:
    """A model from labelled rows that aren't held out.

    ``per_class`` bounds the sample: about so many documents of each class, chosen by the
    hash of their id, or all of a class that has fewer. Every character is a symbol of its
    own. One fold of the sample is kept from the counts and calibrates the score, at equal
    weight of both classes, which also evens out what classes of different sizes know.
    """
    spark = docs.sparkSession
    sample = checkpoint(labelled_sample(docs, labels.where(~held_out(F.col("doc_id"))), "toxic", per_class, "toxicity sample"))
    counted = sample.where(fold(F.col("doc_id")) != CALIBRATION_FOLD).select("text", "toxic")

    def count(batches):
        for batch in batches:
            for a, b in slices(batch.column("text"), 500_000):
                marks = batch.column("toxic").slice(a, b - a).to_pylist()
                texts = batch.column("text").slice(a, b - a).to_pylist()
                for mark in (0, 1):
                    words = [w for t, m in zip(texts, marks) if m == mark for w in words_of(t)]
                    if words:
                        _, grams, group = _distinct(ngrams(words)[0])
                        n = np.bincount(group)
                        yield pa.RecordBatch.from_arrays([*map(pa.array, grams.T.copy()), pa.array(n * mark), pa.array(n * (1 - mark))], names=["early", "late", "toxic", "ordinary"])

    sums = counted.mapInArrow(count, "early long, late long, toxic long, ordinary long").groupBy("early", "late").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toPandas()
    words = fit(sums[["early", "late"]].to_numpy(np.int64), sums["toxic"].to_numpy(), sums["ordinary"].to_numpy())
    given = spark.sparkContext.broadcast(words)

    def seen(texts):
        x = Scorer(given.value).features(texts)
        return [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))]

    points = map_texts(sample.where(fold(F.col("doc_id")) == CALIBRATION_FOLD), seen, "x array<double>", carry=("toxic",)).toPandas()
    y = points["toxic"].to_numpy(np.float64)
    weights = _logistic(np.stack(points["x"].to_numpy()), y) if 0 < y.sum() < len(y) else np.array([1.0] * FEATURES + [0.0])
    return ToxicityModel(words, weights)


def predict(docs: DataFrame, model: ToxicityModel, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, score (0 to 1) and predicted of each whole text.

    The score compares the two models' log-likelihoods per word, over the whole text, over
    its most toxic passage of 32 words, and of its most toxic words, so that one passage or
    word shows in a text of any length. Null texts and texts without letters have ratio zero and get the score of that.
    Repeated rows each return a row; an empty table gives none; other columns never count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorers: list[Scorer] = []

    def work(texts):
        if not scorers:
            scorers.append(Scorer(shared.value.words))
        score = shared.value.score(scorers[0].features(texts))
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    return map_texts(docs, work, "score double, predicted int", carry)
