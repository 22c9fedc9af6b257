"""Token counts under edits: a segment tree of pre-tokens per document, re-encoded only where edits touch."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlake.llm.common import SLICE_CHARS, slices, starts_of

#: The default rank file's place and the pre-token pattern that goes with it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A pre-token may depend on so many characters after its end: a contraction looks two ahead.
CONTEXT = 4
BLOCK = 64
CACHE = 400_000
EDIT_TYPE = "array<struct<start:int,length:int,text:string>>"


class Counter:
    """Splits texts into pre-tokens and counts the tokens of each; counts of CACHE pre-tokens are kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        if "(?<" in pattern:
            raise ValueError("the pattern must not look behind: splitting starts again inside a text")
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def counts(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        for t in set(tokens).difference(self.known):
            self.known[t] = len(self.encoding.encode_ordinary(t))
        return np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)


class TokenTree:
    """A text as pre-tokens under a binary tree of sums: leaves, characters and tokens below each node.

    The lowest nodes are blocks of about BLOCK pre-tokens, so that an edit changes the
    leaves of a block or a few and the sums on the paths from them to the root.
    """

    def __init__(self, text: str, chars: Sequence[int], counts: np.ndarray):
        self.text = text
        self.chars = np.asarray(chars, dtype=np.int64)
        self.tokens = counts
        self.recoded = 0
        self._build()

    @property
    def total(self) -> int:
        return int(self.nodes[1, 2])

    def _build(self) -> None:
        blocks = max(1, -(-len(self.chars) // BLOCK))
        width = 1 << (blocks - 1).bit_length()
        self.nodes = np.zeros((2 * width, 3), dtype=np.int64)
        if len(self.chars):
            heads = np.arange(0, len(self.chars), BLOCK)
            self.nodes[width : width + blocks, 0] = np.diff(np.append(heads, len(self.chars)))
            self.nodes[width : width + blocks, 1] = np.add.reduceat(self.chars, heads)
            self.nodes[width : width + blocks, 2] = np.add.reduceat(self.tokens, heads)
        while width > 1:
            width //= 2
            self.nodes[width : 2 * width] = self.nodes[2 * width : 4 * width : 2] + self.nodes[2 * width + 1 : 4 * width : 2]

    def _find(self, at: int, what: int) -> tuple[int, int, int]:
        """(block, its first leaf, its first character) of the block that holds leaf (0) or character (1) ``at``."""
        width = len(self.nodes) // 2
        node, leaf, char = 1, 0, 0
        while node < width:
            left = self.nodes[2 * node]
            if at < (leaf, char)[what] + left[what] or not self.nodes[2 * node + 1, 0]:
                node = 2 * node
            else:
                leaf, char, node = leaf + int(left[0]), char + int(left[1]), 2 * node + 1
        return node, leaf, char

    def edit(self, counter: Counter, start: int, length: int, new: str) -> None:
        """Replace ``length`` characters at ``start`` (both clipped to the text) by ``new``.

        Splitting starts again at the last pre-token that ends CONTEXT or more characters
        before the edit and goes on until a new boundary past the edit falls on an old one;
        splitting doesn't look back, so all after it stays as it was.
        """
        start = max(0, min(start, len(self.text)))
        length = max(0, min(length, len(self.text) - start))
        self.text = self.text[:start] + new + self.text[start + length :]
        shift = len(new) - length
        _, leaf, char = self._find(max(0, start - CONTEXT), 1)
        while leaf < len(self.chars) and char + self.chars[leaf] <= start - CONTEXT:
            char += int(self.chars[leaf])
            leaf += 1
        first, begin = leaf, char
        fresh: list[str] = []
        for match in counter.pattern.finditer(self.text, pos=begin):
            fresh.append(match.group())
            end = match.end()
            while leaf < len(self.chars) and char + shift < end:
                char += int(self.chars[leaf])
                leaf += 1
            if end >= start + len(new) and char + shift == end and char >= start + length:
                break
        else:
            leaf = len(self.chars)
        self.recoded += len(fresh)
        self._splice(first, leaf, np.fromiter(map(len, fresh), dtype=np.int64, count=len(fresh)), counter.counts(fresh))

    def _splice(self, first: int, last: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Put new leaves in the place of leaves first to last - 1 and update the sums above them."""
        width = len(self.nodes) // 2
        head, head_leaf, _ = self._find(first, 0)
        spans = []  # (block, its first leaf, leaves) of the blocks that lose leaves
        block, leaf = head, head_leaf
        while True:
            n = int(self.nodes[block, 0])
            spans.append((block, leaf, n))
            leaf += n
            if leaf >= last or block + 1 >= 2 * width:
                break
            block += 1
        for block, leaf, n in spans:
            a, b = max(first, leaf), min(last, leaf + n)
            if a < b:
                self.nodes[block] -= (b - a, self.chars[a:b].sum(), self.tokens[a:b].sum())
        self.nodes[head] += (len(chars), chars.sum(), tokens.sum())
        self.chars = np.concatenate([self.chars[:first], chars, self.chars[last:]])
        self.tokens = np.concatenate([self.tokens[:first], tokens, self.tokens[last:]])
        if self.nodes[head, 0] > 8 * BLOCK:
            self._build()
            return
        parents = {block // 2 for block, _, _ in spans}
        while parents and 0 not in parents:
            for p in parents:
                self.nodes[p] = self.nodes[2 * p] + self.nodes[2 * p + 1]
            parents = {p // 2 for p in parents}


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def trees(counter: Counter, texts: Sequence[str | None]) -> Iterable[TokenTree]:
    lists = [counter.split(t or "") for t in texts]
    starts = starts_of([len(x) for x in lists])
    counts = counter.counts([t for x in lists for t in x])
    for i, t in enumerate(texts):
        yield TokenTree(t or "", list(map(len, lists[i])), counts[starts[i] : starts[i + 1]])


def count_tokens(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens, n_tokens_edited, n_recoded.

    n_tokens counts the whole text. Where ``docs`` has a column ``edits`` (array of start,
    length, text), these are applied in order to the document's tree, each to the text that
    the one before left, and n_tokens_edited is the new count; n_recoded is the number of
    pre-tokens that had to be encoded for it. Offsets count code points and are clipped.

    Null texts count as empty, null edits as none; null parts of an edit are 0 or empty.
    Repeated rows each return a row; an empty table gives none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    edits = F.col("edits") if "edits" in docs.columns else F.array()
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), edits.cast(EDIT_TYPE).alias("edits"))

    def run(batches):
        counter = Counter(shared.value, pattern)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                rows = []
                own = batch.column("edits").slice(a, b - a).to_pylist()
                for tree, changes in zip(trees(counter, batch.column("text").slice(a, b - a).to_pylist()), own):
                    before = len(tree.chars), tree.total
                    for e in changes or []:
                        if e is not None:
                            tree.edit(counter, e["start"] or 0, e["length"] or 0, e["text"] or "")
                    rows.append((*before, tree.total, tree.recoded))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(x, pa.int64()) for x in zip(*rows))], names=["doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_recoded"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long, n_tokens_edited long, n_recoded long")


TREES = "text string, chars array<int>, tokens array<int>"


def tree_table(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id and a tree of each document as a row: its text, and characters and tokens of its pre-tokens.

    The rows can be kept as a table; `apply_edits` goes on from them, so that only what later
    edits touch is encoded again, in whatever job. Null texts count as empty.
    """
    return _edited_trees(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.lit(None).cast("array<int>").alias("chars"), F.lit(None).cast("array<int>").alias("tokens"), F.array().cast(EDIT_TYPE).alias("edits")), path, pattern).drop("n_recoded")


def apply_edits(trees: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """The rows of `tree_table` (doc_id, text, chars, tokens), which have ``edits``, after those edits; and n_tokens, n_recoded."""
    return _edited_trees(trees.select("doc_id", "text", "chars", "tokens", F.col("edits").cast(EDIT_TYPE).alias("edits")), path, pattern)


def _edited_trees(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches):
        counter = Counter(shared.value, pattern)
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE_CHARS // 4):
                part = batch.slice(a, b - a)
                texts = part.column("text").to_pylist()
                made = []
                for text, chars, tokens, edits in zip(texts, *(part.column(c).to_pylist() for c in ("chars", "tokens", "edits"))):
                    tree = next(iter(trees(counter, [text]))) if chars is None or tokens is None else TokenTree(text or "", chars, np.array(tokens, dtype=np.int64))
                    for e in edits or []:
                        if e is not None:
                            tree.edit(counter, e["start"] or 0, e["length"] or 0, e["text"] or "")
                    made.append(tree)
                lists = [pa.array([getattr(t, c).tolist() for t in made], pa.list_(pa.int32())) for c in ("chars", "tokens")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([t.text for t in made], pa.string()), *lists, pa.array([t.total for t in made], pa.int64()), pa.array([t.recoded for t in made], pa.int64())], names=["doc_id", "text", "chars", "tokens", "n_tokens", "n_recoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {TREES}, n_tokens long, n_recoded long")


def revision(docs: DataFrame) -> DataFrame:
    """The documents with three edits each: a replacement, an insertion inside the text, and a cut at its end."""
    n = F.coalesce(F.length("text"), F.lit(0))
    change = [
        F.struct((n / 3).cast("int").alias("start"), F.lit(20).alias("length"), F.lit(" (second edition, 2nd print) ").alias("text")),
        F.struct((n / 2).cast("int").alias("start"), F.lit(0).alias("length"), F.lit("re").alias("text")),
        F.struct((n - n / 10).cast("int").alias("start"), F.lit(7).alias("length"), F.lit("").alias("text")),
    ]
    return docs.select("doc_id", "text", F.array(*change).alias("edits"))
