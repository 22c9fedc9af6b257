"""LM scoring: cross-entropy difference of a target and a background character n-gram model."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringlake.llm.common import new_folder, segment_sum, slices, starts_of

#: Tokens are characters; an n-gram of any order is counted under a 64-bit key of its own.
ORDER = 5
SMOOTHING = 4.0
#: Stands before the start of a text; no character has this code.
START = 0x110000
#: Characters that are counted at once, and scored at once: small enough for a core's cache there.
LOOK_CHARS, SCORE_CHARS = 500_000, 40_000
#: Distinct n-grams that a counting task holds before it sends them on.
HELD_GRAMS = 2_000_000
#: N-grams of a slice that a scoring task holds and indexes at once.
PART_GRAMS = 4_000_000
#: (longest text, texts together) in a slice: 256 million characters at most, mostly far fewer; a longer text is a slice.
SLICE_SIZES = ((16_384, 16_384), (1_048_576, 256))
#: So many ids of the target, counted first, are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def _mixed(code: np.ndarray) -> np.ndarray:
    return code * np.uint64(0x9E3779B97F4A7C15)


def _longer(mixed: np.ndarray, earlier) -> np.ndarray:
    """The key of each n-gram with one more character before it; one to one for each character."""
    mixed = (mixed ^ (mixed >> np.uint64(29)) ^ earlier) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _grams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, starts): for each character the keys of the n-grams that end there, orders 1 to ORDER in rows.

    Contexts don't reach over the start of a text: there they see START.
    """
    given = [t or "" for t in texts]
    starts = starts_of([len(t) for t in given])
    codes = np.frombuffer("".join(given).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    place = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
    keys = np.empty((ORDER, len(codes)), dtype=np.uint64)
    keys[0] = _mixed(codes)
    for k in range(1, ORDER):
        earlier = np.full(len(codes), START, dtype=np.uint64)
        earlier[k:] = codes[: max(len(codes) - k, 0)]
        earlier[place < k] = START
        keys[k] = _longer(keys[k - 1], earlier + np.uint64(k << 32))
    return keys, starts


def _start_keys() -> np.ndarray:
    """The keys, of orders 1 to ORDER - 1, of contexts that lie wholly before a text."""
    out = [_mixed(np.array([START], dtype=np.uint64))]
    for k in range(1, ORDER - 1):
        out.append(_longer(out[-1], np.uint64(START + (k << 32))))
    return np.concatenate(out)


START_KEYS = _start_keys()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their rows of counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], segment_sum(counts[order], np.append(first, len(keys)))


class Lookup:
    """Finds keys in an ascending array of distinct ones, in slots by their highest bits, the next free one if taken."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(1, int(2 * len(keys)).bit_length())
        home = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        at = np.maximum.accumulate(home - np.arange(len(keys))) + np.arange(len(keys)) if len(keys) else home
        self.reach = int((at - home).max(initial=0))
        self.row = np.full((1 << self.bits) + len(keys) + 1, -1, dtype=np.int32)
        self.row[at] = np.arange(len(keys))
        self.key = np.zeros(len(self.row), dtype=np.uint64)
        self.key[at] = keys

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if there is none."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.key[slot] == keys, self.row[slot], -1)
        left = np.flatnonzero(out < 0)
        for step in range(1, self.reach + 1):
            if not len(left):
                break
            at = slot[left] + step
            hit = self.key[at] == keys[left]
            out[left[hit]] = self.row[at[hit]]
            left = left[~hit & (self.row[at] >= 0)]
        return out


@dataclass
class Answers:
    """What the corpus has of the n-grams of one slice of texts: a table of files in the shared folder.

    A slice of up to PART_GRAMS n-grams is read and indexed once. The n-grams of a larger one
    go past once for each run of texts that asks for so many of them (see `prepare`), and
    only those asked for are kept and indexed.
    """

    folder: str
    part: int
    slice: int
    large: bool = False
    held: tuple[Lookup, np.ndarray, np.ndarray] | None = None

    def _batches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, counts in the target, counts in the corpus) of the slice, file by file; a key may come again."""
        system, path = FileSystem.from_uri(f"{self.folder}/part={self.part}")
        for batch in ds.dataset(path, filesystem=system, format="parquet").to_batches(columns=["key", "target", "background"], filter=ds.field("slice") == self.slice, use_threads=False):
            key, *counts = (batch.column(c).to_numpy() for c in ("key", "target", "background"))
            yield key.view(np.uint64), *counts

    def _whole(self) -> bool:
        """Read and index the slice, if it is small enough."""
        waiting, size = [], 0
        for batch in self._batches():
            waiting.append(batch)
            size += len(batch[0])
            if size > PART_GRAMS:
                return False
        empty = [(np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 2)]
        keys, target, background = (np.concatenate(c) for c in zip(*(empty + waiting)))
        keys, at = np.unique(keys, return_index=True)
        self.held = Lookup(keys), target[at], background[at]
        return True

    def prepare(self, texts: Sequence[str | None]) -> None:
        """Have the answers for ``texts`` at hand: those of the whole slice, or of their own n-grams."""
        if not self.large:
            if self.held is not None or self._whole():
                return
            self.large = True
        asked = np.unique(np.concatenate([_grams(texts)[0].ravel(), START_KEYS]))
        target, background = (np.zeros(len(asked), dtype=np.int64) for _ in range(2))
        for key, t, b in self._batches():
            at = np.minimum(np.searchsorted(asked, key), len(asked) - 1)
            hit = asked[at] == key
            target[at[hit]], background[at[hit]] = t[hit], b[hit]
        self.held = Lookup(asked), target, background

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, count in the target, count in the corpus) of each key of prepared texts; equal keys have equal numbers."""
        look, target, background = self.held
        at = look(keys)
        if len(target) and at.min(initial=0) >= 0:
            return at, target[at], background[at]
        number, *counts = (np.zeros(len(keys), dtype=np.int64) for _ in range(3))
        hit = np.flatnonzero(at >= 0)
        number[hit], counts[0][hit], counts[1][hit] = at[hit], target[at[hit]], background[at[hit]]
        return number, *counts


@dataclass(frozen=True)
class Totals:
    """Characters of the target and of the corpus, and how many different ones the corpus has."""

    target: int
    background: int
    vocabulary: int

    @property
    def scale(self) -> float:
        """What a count of the corpus counts: both models are of the target's size."""
        return self.target / self.background if self.target and self.background else 1.0

    def losses(self, texts: Sequence[str | None], is_target: np.ndarray, answers: Answers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(target loss, background loss, starts) of each character, in nats, under counts without the text's own.

        p_k(c | context) = (n(context c) + SMOOTHING * p_{k-1}(c)) / (n(context) + SMOOTHING), p_1
        with one count spread over the shared vocabulary, which is every character of the corpus.
        """
        keys, starts = _grams(texts)
        n = keys.shape[1]
        number, *counts = answers(np.concatenate([keys.ravel(), START_KEYS]))
        number = number[: keys.size].reshape(keys.shape)
        own = np.empty(keys.shape)
        tally, one = np.zeros(int(number.max(initial=0)) + 1, dtype=np.int32), np.int32(1)  # of one type: a plain 1 is ten times slower
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            at = number[:, a:b]
            np.add.at(tally, at.ravel(), one)
            own[:, a:b] = tally[at]
            tally[at] = 0
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        mine = (is_target.astype(np.float64)[owner], np.ones(n))
        size = np.diff(starts)[owner]
        begin = starts[:-1][np.diff(starts) > 0]
        out = []
        for total, scale, of, found in zip((self.target, self.background), (1.0, self.scale), mine, counts):
            left = (found[: keys.size].reshape(keys.shape) - own * of) * scale
            before = found[keys.size :]
            p = (left[0] + 1.0 / self.vocabulary) / ((total - size * of) * scale + 1.0)
            for k in range(1, ORDER):
                context = np.empty(n)
                context[1:] = left[k - 1][:-1]
                context[begin] = (before[k - 1] - of[begin]) * scale
                p = (left[k] + SMOOTHING * p) / (context + SMOOTHING)
            out.append(-np.log(p))
        return out[0], out[1], starts


def _in_slices(flagged: DataFrame) -> DataFrame:
    """(doc_id, text, target, part, slice): texts of like length of a partition side by side, so many together as SLICE_SIZES says."""
    kind = F.lit(len(SLICE_SIZES))
    for k, (longest, _) in reversed(list(enumerate(SLICE_SIZES))):
        kind = F.when(F.length("text") <= longest, k).otherwise(kind)
    together = F.element_at(F.array(*[F.lit(n) for _, n in SLICE_SIZES], F.lit(1)), F.col("kind") + 1)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    number = (F.floor(place / together) + F.shiftleft(F.col("kind").cast("long"), 33)).cast("long")
    return flagged.withColumn("kind", kind).sortWithinPartitions("kind").select("doc_id", "text", "target", F.spark_partition_id().alias("part"), number.alias("slice"))


def _counted(texts: DataFrame) -> DataFrame:
    """(part, slice, single, key, target, background): counts of the n-grams of each slice.

    ``single`` marks order 1. A task that holds HELD_GRAMS sends them on and begins anew.
    """
    names = ["part", "slice", "single", "key", "target", "background"]

    def rows(at, keys, counts, single):
        for a in range(0, len(keys), 100_000):
            k, n = keys[a : a + 100_000].view(np.int64), counts[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), at[0], dtype=np.int32)), pa.array(np.full(len(k), at[1])), pa.array(np.full(len(k), single)), pa.array(k), pa.array(n[:, 0]), pa.array(n[:, 1])], names=names)

    def sent(at, held, begun):
        for single, parts in held.items():
            if parts:
                yield from rows(at, *_summed(*map(np.concatenate, zip(*parts))), single)
                parts.clear()
        if begun[1]:
            yield from rows(at, START_KEYS, np.tile(begun, (len(START_KEYS), 1)), False)
            begun[:] = 0

    def work(batches) -> Iterator[pa.RecordBatch]:
        at, held, begun, size = None, {True: [], False: []}, np.zeros(2, dtype=np.int64), 0
        for batch in batches:
            place = np.column_stack([batch.column(c).to_numpy() for c in ("part", "slice")])
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
                if at != tuple(place[x].tolist()):
                    yield from sent(at, held, begun)
                    at, size = tuple(place[x].tolist()), 0
                run = batch.slice(x, y - x)
                marks = run.column("target").to_numpy()
                for a, b in slices(run.column("text"), LOOK_CHARS):
                    given = run.column("text").slice(a, b - a).to_pylist()
                    for mark in (0, 1):
                        keys, starts = _grams([t for t, m in zip(given, marks[a:b]) if m == mark])
                        to = np.array([mark, 1])  # the background is the whole corpus
                        begun += int((np.diff(starts) > 0).sum()) * to  # contexts of first characters
                        for single, some in ((True, keys[0]), (False, keys[1:].ravel())):
                            key, n = np.unique(some, return_counts=True)
                            held[single].append((key, n[:, None] * to))
                            size += len(key)
                    if size > HELD_GRAMS:
                        for parts in held.values():
                            parts[:] = [_summed(*map(np.concatenate, zip(*parts)))]
                        size = sum(len(parts[0][0]) for parts in held.values())
                        if size > HELD_GRAMS // 2:
                            yield from sent(at, held, begun)
                            size = 0
        yield from sent(at, held, begun)

    return texts.select("part", "slice", "text", "target").mapInArrow(work, "part int, slice long, single boolean, key long, target long, background long")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, score, n_tokens, target_loss and background_loss of each whole text.

    The target model counts the documents in ``target_ids`` (doc_id), the background model
    all, brought down to the target's size so that both trust their counts alike. Each text
    is scored under counts without its own, so that the score of a target document doesn't
    say that the model has seen it. Losses are means over a text's characters, in nats; score
    is background_loss - target_loss: above 0 where the target model fits better.

    Nothing is sampled and no n-grams share a count. Texts are written once to the shared
    folder in slices; a slice sends its distinct n-grams, with their counts, to where Spark
    adds up each n-gram over all slices, and gets back what the corpus has of them. So no
    task ever reads more of the corpus' counts than its own texts ask for.

    Null and empty texts have no tokens and score 0. Rows of null doc_id are background.
    Repeated rows each return a row and are each other's evidence. Without target rows
    target_loss is that of a uniform model. An empty table gives no rows; other columns never
    count.
    """
    ids = target_ids.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__t")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    flagged = docs.select("doc_id", text.alias("text")).join(ids, F.col("doc_id") == F.col("__t"), "left")
    folder = new_folder(docs.sparkSession, "lm")
    placed = _in_slices(flagged.select("doc_id", "text", F.col("__t").isNotNull().cast("int").alias("target")))
    placed.write.parquet(f"{folder}/texts")
    texts = docs.sparkSession.read.schema(placed.schema).parquet(f"{folder}/texts")
    same = Window.partitionBy("key")
    counts = _counted(texts).select("part", "slice", "single", "key", *(F.sum(c).over(same).alias(c) for c in ("target", "background")))
    counts.repartition("part").sortWithinPartitions("part", "slice").write.partitionBy("part").parquet(f"{folder}/counts")
    singles = docs.sparkSession.read.schema("slice long, single boolean, key long, target long, background long, part int").parquet(f"{folder}/counts")
    singles = singles.where("single").groupBy("key").agg(F.first("target").alias("t"), F.first("background").alias("b"))
    t, b, v = singles.agg(F.sum("t"), F.sum("b"), F.count("*")).first()
    return _scored(texts, Totals(t or 0, b or 0, max(v, 1)), f"{folder}/counts")


def _runs(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """((part, slice), rows) of runs of rows of one slice, of about ``limit`` bytes of text."""
    for a, b in slices(batch.column("text"), limit):
        piece = batch.slice(a, b - a)
        place = np.column_stack([piece.column(c).to_numpy() for c in ("part", "slice")])
        cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
            yield tuple(place[x].tolist()), piece.slice(x, y - x)


def _scored(texts: DataFrame, totals: Totals, folder: str) -> DataFrame:
    def work(batches) -> Iterator[pa.RecordBatch]:
        answers = None
        for batch in batches:
            for at, wide in _runs(batch, PART_GRAMS // ORDER):
                if answers is None or (answers.part, answers.slice) != at:
                    answers = Answers(folder, *at)
                known = False
                for _, run in _runs(wide, SCORE_CHARS):
                    given = run.column("text").to_pylist()
                    n, losses = np.array([len(t) for t in given], dtype=np.int64), [np.zeros(len(given))] * 2
                    if n.any():
                        if not known and (answers.large or answers.held is None):
                            answers.prepare(wide.column("text").to_pylist())
                        known = True
                        *each, starts = totals.losses(given, run.column("target").to_numpy(), answers)
                        losses = [segment_sum(e, starts) / np.maximum(n, 1) for e in each]
                    yield pa.RecordBatch.from_arrays([run.column("doc_id"), pa.array(losses[1] - losses[0]), pa.array(n), *map(pa.array, losses)], names=["doc_id", "score", "n_tokens", "target_loss", "background_loss"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(work, f"doc_id {kind}, score double, n_tokens long, target_loss double, background_loss double")
