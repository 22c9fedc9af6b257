"""SentencePiece encoding and decoding of BPE models by suffix-array matching.

The distinct chunks of a batch are concatenated and indexed by a suffix array; every piece
of the vocabulary is binary-searched in it, and each occurrence is an edge from its start to
its end. Edges are ordered by position and relaxed: of the edges that join two neighbouring
symbols, the one of the best score (leftmost among equals) becomes a symbol, until none is
left. That is the order of merges of a SentencePiece BPE model, so the ids are its ids.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlake.llm.common import map_texts, starts_of

SPACE = "▁"
#: The model file's default place; any BPE model of the library's format will do.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Chunks whose ids are kept, some 220 bytes each in a worker.
CACHE_CHUNKS = 200_000
#: Characters of text that are cut into chunks at once, one text at least.
RUN_CHARS = 250_000
BATCH_CHARS = 200_000
BLOCK_CHARS = 400_000
#: Longer chunks are relaxed one by one with a heap, the others together round by round.
LONG = 48
NONE = np.iinfo(np.int32).max
BPE = 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass(frozen=True)
class PieceModel:
    """A BPE vocabulary as tables. Pieces of two characters or more are numbered by falling score."""

    ids: np.ndarray  # id of each such piece
    level: np.ndarray  # dense rank of its score; equal scores have equal levels
    lengths: np.ndarray
    symbols: np.ndarray  # (pieces, longest): numbers of their characters, 0 beyond the end
    char_number: np.ndarray  # number of each code point in those pieces, 0 for others
    char_id: np.ndarray  # id of each code point that is a piece, else -1
    byte_ids: np.ndarray  # ids of the 256 byte pieces
    output: tuple[bytes, ...]  # what each id decodes to
    pattern: str  # chunks that no piece crosses

    @staticmethod
    def load(path: str = MODEL) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if m.trainer_spec.model_type != BPE or not m.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not (n.add_dummy_prefix and n.escape_whitespaces) or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisation with a dummy prefix is supported")
        if any(p.type == USER for p in m.pieces):
            raise ValueError("user-defined pieces are not supported")
        found = [(p.score, i, p.piece) for i, p in enumerate(m.pieces) if p.type == NORMAL]
        merged = sorted((x for x in found if len(x[2]) > 1), key=lambda x: (-x[0], x[1]))
        letters = sorted({c for _, _, s in merged for c in s})
        if len(letters) >= 1 << 16:
            raise ValueError("pieces of more than 65,535 different characters are not supported")
        number = np.zeros(0x110000, dtype=np.int32)
        number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        longest = max((len(s) for _, _, s in merged), default=2)
        longest += -longest % 8
        symbols = np.zeros((len(merged), longest), dtype=np.int32)
        for k, (_, _, s) in enumerate(merged):
            symbols[k, : len(s)] = number[[ord(c) for c in s]]
        score = np.array([x[0] for x in merged])
        char_id = np.full(0x110000, -1, dtype=np.int32)
        for _, i, s in found:
            if len(s) == 1:
                char_id[ord(s)] = i
        bytes_ = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        output = tuple(bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else " ⁇ ".encode() if p.type == UNKNOWN else b"" for p in m.pieces)
        # no piece has a space after another character, nor a character outside `letters`
        inner = "".join(re.escape(c) for c in letters if c != SPACE)
        crossing = any(SPACE in s.lstrip(SPACE) for _, _, s in merged)
        glue = f"[{inner}{SPACE}]+" if crossing else f"{SPACE}*[{inner}]+|{SPACE}+"
        return PieceModel(
            np.array([x[1] for x in merged], dtype=np.int32), np.unique(-score, return_inverse=True)[1].astype(np.int32), np.array([len(x[2]) for x in merged], dtype=np.int32),
            symbols, number, char_id, np.array([bytes_[b] for b in range(256)], dtype=np.int32), output, f"(?s:{glue}|.)",
        )


def _packed(symbols: np.ndarray, wide: bool) -> list[np.ndarray]:
    """Rows of symbols as big-endian 64-bit keys that compare like the rows; the width is a multiple of 8."""
    rows = np.ascontiguousarray(symbols.astype(">u2" if wide else np.uint8))
    keys = rows.view(np.uint8).reshape(len(rows), -1).view(">u8").astype(np.uint64)
    return list(keys.T)


def _suffix_keys(symbols: np.ndarray, longest: int, wide: bool) -> list[np.ndarray]:
    """For each position, the next ``longest`` symbols as keys like those of `_packed`."""
    bits, each = (16, 4) if wide else (8, 8)
    padded = np.concatenate([symbols, np.zeros(longest + each, dtype=symbols.dtype)]).astype(np.uint64)
    width = 1
    while width < each:
        padded = (padded[:-width] << np.uint64(bits * width)) | padded[width:]
        width *= 2
    return [padded[a : a + len(symbols)] for a in range(0, longest, each)]


def _bisect(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """Places of rows of keys in rows that are sorted, before or after equal rows."""
    n = len(keys[0])
    low, high = np.zeros(len(wanted[0]), dtype=np.int64), np.full(len(wanted[0]), n, dtype=np.int64)
    for _ in range(n.bit_length()):
        open_ = low < high
        mid = np.minimum((low + high) >> 1, n - 1)
        less = np.zeros(len(mid), dtype=bool)
        equal = np.ones(len(mid), dtype=bool)
        for k, w in zip(keys, wanted):
            at = k[mid]
            less |= equal & (at < w)
            equal &= at == w
        up = open_ & (less | equal if right else less)
        low = np.where(up, mid + 1, low)
        high = np.where(open_ & ~up, mid, high)
    return low


def edges(model: PieceModel, codes: np.ndarray) -> np.ndarray:
    """(positions, longest + 1) table: the piece that starts at a position and has that length, or NONE.

    ``codes`` are the concatenated chunks with code point 0 between them. The suffix array
    orders positions by as many characters as the longest piece has; a piece's occurrences
    are one range of it. Writing the edges into the table orders them by position. Suffixes of
    BLOCK_CHARS positions are indexed at a time: an edge needs no more than the longest piece
    beyond them.
    """
    longest = model.symbols.shape[1]
    if len(codes) <= BLOCK_CHARS:
        return _edges_of_block(model, codes)
    table = np.empty((len(codes), longest + 1), dtype=np.int32)
    for a in range(0, len(codes), BLOCK_CHARS):
        table[a : a + BLOCK_CHARS] = _edges_of_block(model, codes[a : a + BLOCK_CHARS + longest])[:BLOCK_CHARS]
    return table


def _edges_of_block(model: PieceModel, codes: np.ndarray) -> np.ndarray:
    longest = model.symbols.shape[1]
    numbers = model.char_number[codes]
    present = np.flatnonzero(np.bincount(numbers, minlength=1)[1:]) + 1
    wide = len(present) > 254
    local = np.zeros(int(model.char_number.max()) + 1, dtype=np.int32)
    local[present] = np.arange(1, len(present) + 1)
    keys = _suffix_keys(local[numbers], longest, wide)
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    pieces = local[model.symbols]
    usable = np.flatnonzero(((pieces > 0) | (model.symbols == 0)).all(axis=1))
    table = np.full((len(codes), longest + 1), NONE, dtype=np.int32)
    if not len(usable):
        return table
    pieces, length = pieces[usable], model.lengths[usable]
    first = _bisect(keys, _packed(pieces, wide), right=False)
    beyond = np.arange(longest) >= length[:, None]
    last = _bisect(keys, _packed(np.where(beyond, 0xFFFF if wide else 0xFF, pieces), wide), right=True)
    count = np.maximum(last - first, 0)
    offsets = starts_of(count)
    rank = np.repeat(first - offsets[:-1], count) + np.arange(offsets[-1])
    table[order[rank], np.repeat(length, count)] = np.repeat(usable, count)
    return table


def _relax_together(model: PieceModel, table: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, start, length) of the final symbols: one merge in each open chunk per round."""
    longest = table.shape[1] - 1
    level = np.append(model.level, NONE).astype(np.int64)
    chunk = np.repeat(np.arange(len(begin)), size)
    start = np.repeat(begin - starts_of(size)[:-1], size) + np.arange(size.sum())
    length = np.ones(len(start), dtype=np.int64)
    done = []
    while len(start):
        joined = np.zeros(len(start), dtype=np.int64)
        joined[:-1] = np.where(chunk[1:] == chunk[:-1], length[1:] + length[:-1], 0)
        ok = (joined > 0) & (joined <= longest)
        piece = np.full(len(start), NONE, dtype=np.int64)
        piece[ok] = table[start[ok], joined[ok]]
        best = (level[np.minimum(piece, len(level) - 1)] << 32) | np.arange(len(start))
        heads = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        least = np.minimum.reduceat(best, heads)
        found = (least >> 32) < NONE
        still = np.repeat(found, np.diff(np.append(heads, len(start))))
        done.append((chunk[~still], start[~still], length[~still]))
        at = least[found] & 0xFFFFFFFF
        length[at] += length[at + 1]
        still[at + 1] = False
        chunk, start, length = chunk[still], start[still], length[still]
    out = [np.concatenate(x) for x in zip(*done)] if done else [np.zeros(0, dtype=np.int64)] * 3
    sort = np.argsort(out[1], kind="stable")
    return out[0][sort], out[1][sort], out[2][sort]


def _relax_long(model: PieceModel, table: np.ndarray, begin: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the final symbols of one chunk, by a heap of edges between neighbours."""
    longest = table.shape[1] - 1
    length = [1] * size
    before, after = list(range(-1, size - 1)), [*range(1, size), -1]
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else -1
        if j >= 0 and (n := length[i] + length[j]) <= longest and (p := int(table[begin + i, n])) != NONE:
            heapq.heappush(heap, (int(model.level[p]), i, length[i], length[j]))

    for i in range(size):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if length[i] != a or j < 0 or length[j] != b:
            continue
        length[i], length[j] = a + b, 0
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    kept = [i for i in range(size) if length[i]]
    return np.array(kept, dtype=np.int64) + begin, np.array([length[i] for i in kept], dtype=np.int64)


class Codec:
    """Encodes and decodes texts; ids of chunks are kept between calls, CACHE_CHUNKS of them about."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.chunks = re.compile(model.pattern)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks, BATCH_CHARS at a time (one chunk at least), and keep their ids."""
        sizes = np.cumsum([len(c) + 1 for c in chunks])
        flat, counts = [self.flat], []
        a = 0
        while a < len(chunks):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BATCH_CHARS, side="right")))
            ids, n = self._encode(chunks[a:b])
            flat.append(ids)
            counts.append(n)
            a = b
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        self.flat = np.concatenate(flat)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(counts))])

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        m = self.model
        codes = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        begin = starts_of(size + 1)[:-1]
        table = edges(m, codes)
        short = size <= LONG
        which = np.flatnonzero(short)
        chunk, start, length = _relax_together(m, table, begin[which], size[which])
        parts = [(which[chunk], start, length)]
        for c in np.flatnonzero(~short):
            s, n = _relax_long(m, table, int(begin[c]), int(size[c]))
            parts.append((np.full(len(s), c), s, n))
        chunk, start, length = (np.concatenate(x) for x in zip(*parts))
        sort = np.argsort(start, kind="stable")
        chunk, start, length = chunk[sort], start[sort], length[sort]
        ids = np.where(length > 1, m.ids[np.minimum(table[start, length], len(m.ids) - 1)], m.char_id[codes[start]])
        if (ids < 0).any():  # characters that are no piece: their bytes
            spelled = [m.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] if i < 0 else [i] for i, c in zip(ids.tolist(), codes[start].tolist())]
            chunk = np.repeat(chunk, [len(x) for x in spelled])
            ids = np.concatenate(spelled)
        return ids.astype(np.int32), np.bincount(chunk, minlength=len(chunks))

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts): the ids of all texts, those of text i at starts[i]:starts[i + 1].

        Chunks are held for a run of RUN_CHARS characters only; what is kept of all texts is numbers.
        """
        sizes = starts_of([len(t or "") for t in texts])
        parts, a = [], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + RUN_CHARS, side="right")) - 1)
            parts.append(self._encode_run(texts[a:b]))
            a = b
        counts = [np.diff(starts) for _, starts in parts]
        return np.concatenate([np.zeros(0, dtype=np.int32), *(ids for ids, _ in parts)]), starts_of(np.concatenate([np.zeros(0, dtype=np.int64), *counts]))

    def _encode_run(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE_CHUNKS:
            self.clear()
        lists = [self.chunks.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        bounds = starts_of([len(x) for x in lists])
        chunks = [c for x in lists for c in x]
        at = np.fromiter(map(self.known.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            self.learn(list(dict.fromkeys(chunks[i] for i in missing)))
            at[missing] = np.fromiter((self.known[chunks[i]] for i in missing), dtype=np.int64, count=len(missing))
        count = self.starts[at + 1] - self.starts[at]
        offsets = starts_of(count)
        ids = self.flat[np.repeat(self.starts[at] - offsets[:-1], count) + np.arange(offsets[-1])]
        return ids, offsets[bounds]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of a sequence of ids, without the space that encoding puts before it."""
        text = b"".join(map(self.model.output.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, path: str = MODEL, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, n_tokens, ids and round_trip of each whole text. No shuffle.

    round_trip says that decoding the ids gives the text back, as it does for every text
    without U+2581, which decodes to a space. Null and empty texts have no ids. Long texts and
    long chunks are encoded whole. Repeated rows each return a row; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel.load(path))
    made: list[Codec] = []

    def work(texts):
        made or made.append(Codec(shared.value))
        ids, starts = made[0].encode(texts)
        same = [made[0].decode(ids[a:b].tolist()) == (t or "") for t, a, b in zip(texts, starts.tolist(), starts[1:].tolist())]
        return [pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)), pa.array(same)]

    return map_texts(docs, work, "n_tokens long, ids array<int>, round_trip boolean", carry)


def decode(encoded: DataFrame, path: str = MODEL, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and the text of each row's ``ids``; null ids give null. Ids outside the vocabulary are an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(PieceModel.load(path))
    source = encoded.select(*[F.col(f"`{c}`") for c in carry], F.col("ids").alias("__ids"))

    def run(batches):
        codec = Codec(shared.value)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(texts, pa.string())], names=[*carry, "text"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__ids")
    return source.mapInArrow(run, f"{kept}, text string" if kept else "text string")
