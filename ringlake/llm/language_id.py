"""Language ID: script ranges narrow the candidates, Viterbi over word scores labels spans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlake.llm.common import crc_mod, map_texts, segment_sum, slices, starts_of

#: First and last code point of the ranges that tell scripts apart; all else is `other`.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x2FA1F),
)
SCRIPT_NAMES = (*dict.fromkeys(s[0] for s in SCRIPTS), "other")

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
MAX_GRAM = 4
BITS = 16
UNDECIDED = "und"
CACHE = 300_000


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return crc_mod(doc_id, 4) == 2


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def script_of(words: Sequence[str]) -> np.ndarray:
    """Number of the script of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in words), dtype=np.int64, count=len(words))
    out = np.full(len(words), len(SCRIPT_NAMES) - 1)
    for name, a, b in SCRIPTS:
        out[(first >= a) & (first <= b)] = SCRIPT_NAMES.index(name)
    return out


def word_features(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of the character n-grams of each word and of the whole word.

    N-grams have 1 to MAX_GRAM characters and see the space on either side of the word.
    """
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]  # the space before each word
    owner = np.repeat(np.arange(len(words)), lengths + 1)
    closing = (begin + lengths + 1)[owner]
    at = np.arange(len(owner))
    mixed = codes[: len(owner)] * np.uint64(0x9E3779B97F4A7C15)
    buckets, owners = [], []
    for n in range(1, MAX_GRAM + 1):
        if n > 1:
            mixed = (mixed ^ codes[np.minimum(at + n - 1, len(codes) - 1)]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        fits = at + n - 1 <= closing
        if n == 1:
            fits &= at != begin[owner]
        buckets.append(mixed[fits] >> np.uint64(64 - BITS))
        owners.append(owner[fits])
    # of single characters: longer grams at a word's end would see the next word
    single = codes[: len(owner)] * np.uint64(0x9E3779B97F4A7C15)
    single ^= single >> np.uint64(29)
    whole = np.bitwise_xor.reduceat(single * (2 * (at - begin[owner]) + 1).astype(np.uint64), begin) * np.uint64(0xC2B2AE3D27D4EB4F)
    buckets.append(whole >> np.uint64(64 - BITS))
    owners.append(np.arange(len(words)))
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities of hashed features by language, and the languages of each script."""

    languages: tuple[str, ...]
    log_p: np.ndarray  # (2 ** BITS, languages), float32
    allowed: np.ndarray  # (scripts, languages), bool
    common: int  # the language of most training words

    def score(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, languages) scores, and whether the word's script has a candidate at all."""
        bucket, owner = word_features(words)
        order = np.argsort(owner, kind="stable")
        total = segment_sum(self.log_p[bucket[order]], np.searchsorted(owner[order], np.arange(len(words) + 1))) / MAX_GRAM
        allowed = self.allowed[script_of(words)]
        known = allowed.any(axis=1)
        total = np.where(allowed, total, -1e4)
        total[~known] = 0
        return (total - total.max(axis=1, keepdims=True)).astype(np.float32), known


def train(docs: DataFrame, per_language: int = 3000) -> LanguageModel:
    """A model from the texts of rows that have a language and aren't held out.

    ``per_language`` bounds the sample: each language gives about so many of its documents, or
    all if it has fewer. A document is an id with a text: they are chosen by the hash of
    both, so that texts that share an id, or have none, are in the sample or not one by one,
    and repeated rows count as one of it. The model holds 2^BITS numbers a
    language, whatever the corpus holds: features that share a bucket share their count, which
    blurs rare n-grams. The sample's bound keeps the features few for that; a word has some
    twenty, so that one shared bucket seldom decides. Feature counts are added up in tasks
    before they are shuffled.
    """
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang", F.xxhash64("text").alias("h"))
    sizes = usable.select("lang", "doc_id", "h").distinct().groupBy("lang").count().collect()  # a row for each language
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], per_language / r["count"])])[F.col("lang")] if sizes else F.lit(0.0)
    spread = F.pmod(F.xxhash64("doc_id", "h", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(spread < share).groupBy("lang", "doc_id", "h").agg(F.first("text").alias("text")).select("lang", "text")

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, b in slices(batch.column("text")):
                for lang, text in zip(batch.column("lang").slice(a, b - a).to_pylist(), batch.column("text").slice(a, b - a).to_pylist()):
                    if words := words_of(text):
                        own = held.setdefault(lang, np.zeros((1 << BITS) + len(SCRIPT_NAMES), dtype=np.int64))
                        own[: 1 << BITS] += np.bincount(word_features(words)[0], minlength=1 << BITS)
                        own[1 << BITS :] += np.bincount(script_of(words), minlength=len(SCRIPT_NAMES))
        for lang, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "feature", "n"])

    counts = sample.mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counts["lang"].unique()))
    full = np.zeros(((1 << BITS) + len(SCRIPT_NAMES), len(languages)), dtype=np.float64)
    full[counts["feature"], counts["lang"].map({x: i for i, x in enumerate(languages)})] = counts["n"]
    grams, scripts = full[: 1 << BITS], full[1 << BITS :]
    log_p = np.log((grams + 0.5) / (grams + 0.5).sum(axis=0)).astype(np.float32)
    allowed = scripts >= np.maximum(0.001 * scripts.sum(axis=0), 1) if languages else scripts > 0
    return LanguageModel(languages, log_p, allowed, int(scripts.sum(axis=0).argmax()) if languages else 0)


def viterbi(scores: np.ndarray, starts: np.ndarray, penalty: float, lane: int = 128) -> np.ndarray:
    """Best label of each word when a change of label costs ``penalty``; runs are starts[i]:starts[i + 1].

    Runs are cut into lanes of equal length that advance together. A first pass finds, for
    each lane, the best score between any label before it and any label at its end; joining
    lanes of a run then gives the scores at all their borders, and the path is traced back
    border by border and inside all lanes at once. Exact for any length of run.
    """
    n, k = scores.shape
    counts = np.diff(starts)
    per_run = -(-counts // lane)
    first = starts_of(per_run)
    total = int(first[-1])
    if not total:
        return np.zeros(0, dtype=np.int64)
    run = np.repeat(np.arange(len(counts)), per_run)
    part = np.arange(total) - first[run]
    places = starts[run][:, None] + part[:, None] * lane + np.arange(lane)
    inside = places < starts[run + 1][:, None]
    s = np.where(inside[..., None], scores[np.minimum(places, n - 1)], 0).astype(np.float32)
    through = np.full((total, k, k), -np.inf, dtype=np.float32)
    through[:, np.arange(k), np.arange(k)] = 0
    for t in range(lane):
        through = np.maximum(through, through.max(axis=2, keepdims=True) - penalty) + s[:, t, None, :]
    entry = np.zeros((total, k), dtype=np.float32)
    longest = int(per_run.max())
    for c in range(1, longest):
        here = (first[:-1] + c)[per_run > c]
        before = entry[here - 1]
        after = (before[:, :, None] + through[here - 1]).max(axis=1)
        entry[here] = after - after.max(axis=1, keepdims=True)
    exits = (entry[:, :, None] + through).max(axis=1)
    end = np.zeros(total, dtype=np.int64)
    for c in range(longest - 1, -1, -1):
        here = (first[:-1] + c)[per_run > c]
        last = here == first[1:][per_run > c] - 1
        end[here[last]] = exits[here[last]].argmax(axis=1)
        inner = here[~last]
        end[inner] = (entry[inner + 1] + through[inner + 1][np.arange(len(inner)), :, end[inner + 1]]).argmax(axis=1)
    forward = np.empty((lane, total, k), dtype=np.float32)
    v = entry
    for t in range(lane):
        v = np.maximum(v, v.max(axis=1, keepdims=True) - penalty) + s[:, t]
        forward[t] = v
    labels = np.empty((total, lane), dtype=np.int64)
    rows = np.arange(total)
    for t in range(lane - 1, -1, -1):
        labels[:, t] = end
        v = forward[t - 1] if t else entry
        best = v.argmax(axis=1)
        end = np.where(v[rows, end] >= v[rows, best] - penalty, end, best)
    return labels[inside]


def predict(docs: DataFrame, model: LanguageModel, penalty: float = 6.0, carry: Sequence[str] = ("doc_id",), spans: bool = False, min_score: float | None = None) -> DataFrame:
    """``carry`` columns, lang_pred and score of each whole text (and its spans).

    Words are runs of letters. A word's candidates are the languages that training saw in
    its script; Viterbi with a switching penalty then labels all words of the text. lang_pred
    is the language of most words; score is its share of the words times the probability
    that the words so labelled are of that language. ``spans`` adds the runs of equal label
    as (first word, last word, language). ``min_score`` returns only rows that have a
    language and at least that score.

    Null texts and texts without a letter are `und` with score 0. Letters of scripts that no
    training language has say nothing; a text of only such letters gets the most common
    language with score 0. With no training rows all texts are `und`. Repeated rows each
    return a row; an empty table gives none; other columns never count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict[str, int] = {}
    held = {}

    def scored(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        m = shared.value
        if len(cache) > CACHE or not held:
            cache.clear()
            held["s"], held["k"] = np.zeros((0, len(m.languages)), dtype=np.float32), np.zeros(0, dtype=bool)
        at = np.fromiter(map(cache.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(words[i] for i in missing))
            cache.update(zip(new, range(len(cache), len(cache) + len(new))))
            for a in range(0, len(new), 100_000):
                s, k = m.score(new[a : a + 100_000])
                held["s"], held["k"] = np.concatenate([held["s"], s]), np.concatenate([held["k"], k])
            at[missing] = [cache[words[i]] for i in missing]
        return held["s"][at], held["k"][at]

    def work(texts):
        m = shared.value
        lists = [words_of(t) for t in texts]
        starts = starts_of([len(x) for x in lists])
        names = [UNDECIDED] * len(texts)
        share = np.zeros(len(texts))
        labels = np.zeros(0, dtype=np.int64)
        if m.languages and starts[-1]:
            scores, known = scored([w for x in lists for w in x])
            labels = viterbi(scores, starts, penalty)
            k = len(m.languages)
            owner = np.repeat(np.arange(len(texts)), np.diff(starts))
            votes = np.bincount(owner[known] * k + labels[known], minlength=len(texts) * k).reshape(-1, k)
            best = votes.argmax(axis=1)
            best[votes.sum(axis=1) == 0] = m.common
            own = known & (labels == best[owner])
            sums = segment_sum(np.where(own[:, None], scores, 0).astype(np.float64), starts)
            sums -= sums.max(axis=1, keepdims=True)
            p = np.exp(sums)
            rows = np.arange(len(texts))
            share = votes[rows, best] / np.maximum(votes.sum(axis=1), 1) * p[rows, best] / p.sum(axis=1)
            names = [m.languages[b] if n else UNDECIDED for b, n in zip(best, np.diff(starts))]
        out = [pa.array(names, pa.string()), pa.array(share, pa.float64())]
        if spans:
            out.append(_spans(labels, starts, m.languages))
        return out

    schema = "lang_pred string, score double" + (", spans array<struct<first:int,last:int,lang:string>>" if spans else "")
    keep = None if min_score is None else lambda a: pa.array([n != UNDECIDED and s >= min_score for n, s in zip(a[0].to_pylist(), a[1].to_pylist())])
    return map_texts(docs, work, schema, carry, keep)


SPAN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))


def _spans(labels: np.ndarray, starts: np.ndarray, languages: Sequence[str]) -> pa.Array:
    """The runs of equal label of each text, as lists of SPAN_TYPE."""
    if not len(labels):
        return pa.array([[]] * (len(starts) - 1), SPAN_TYPE)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    cuts = np.flatnonzero((np.diff(labels) != 0) | (np.diff(owner) != 0)) + 1
    first, beyond = np.append(0, cuts), np.append(cuts, len(labels))
    base = starts[owner[first]]
    names = pa.DictionaryArray.from_arrays(pa.array(labels[first].astype(np.int32)), pa.array(languages, pa.string())).cast(pa.string())
    runs = pa.StructArray.from_arrays([pa.array((first - base).astype(np.int32)), pa.array((beyond - 1 - base).astype(np.int32)), names], fields=list(SPAN_TYPE.value_type))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, starts).astype(np.int32)), runs)
