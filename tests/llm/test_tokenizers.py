"""SentencePiece and token counts against the public libraries."""

import os
import random

import numpy as np
import pytest

from ringlake.llm import sentencepiece_codec, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(sentencepiece_codec.MODEL), reason="no tokenizer files here")

HARD = ["", "a", " ", "  a", "   many    spaces   ", "line\nbreak\n\n tab\tx", "日本語 mixed ça été größer", "😀 emoji 🙈🙈", "x" * 500, "ab" * 300, " " * 100, "\x00zero\x00", "İstanbul ﬁ", "the,the;the(the)"]


def random_texts(seed, n, alphabet):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(n)]


# SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)


@pytest.fixture(scope="module")
def model():
    return sentencepiece_codec.PieceModel.load()


def test_ids_are_the_library_s(library, model):
    codec = sentencepiece_codec.Codec(model)
    texts = HARD + random_texts(1, 200, "abcdehilnorstu éßñ.,\n 日本x😀")
    ids, starts = codec.encode(texts)
    for i, t in enumerate(texts):
        own = ids[starts[i] : starts[i + 1]].tolist()
        assert own == library.encode(t), repr(t)[:50]
        assert codec.decode(own) == library.decode(own) == t


def test_short_and_long_chunks_agree(library, model, monkeypatch):
    texts = random_texts(2, 60, "abcdehilnorstu éß.\n")
    monkeypatch.setattr(sentencepiece_codec, "LONG", 0)
    ids, starts = sentencepiece_codec.Codec(model).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [library.encode(t) for t in texts]


def test_blocks_of_positions_change_nothing(library, model, monkeypatch):
    texts = [*random_texts(5, 40, "abcdehilnorstu éß.\n"), "thequickbrown" * 300]
    monkeypatch.setattr(sentencepiece_codec, "BLOCK_CHARS", 61)
    ids, starts = sentencepiece_codec.Codec(model).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [library.encode(t) for t in texts]


def test_many_characters_use_wide_keys(library, model):
    letters = [chr(c) for c in np.flatnonzero(model.char_number)]
    text = " ".join("".join(random.Random(i).choices(letters, k=9)) for i in range(400))
    ids, _ = sentencepiece_codec.Codec(model).encode([text])
    assert ids.tolist() == library.encode(text)


def test_small_caches_and_batches_change_nothing(library, model, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "CACHE_CHUNKS", 5)
    monkeypatch.setattr(sentencepiece_codec, "BATCH_CHARS", 7)
    codec = sentencepiece_codec.Codec(model)
    for t in HARD:
        assert codec.encode([t])[0].tolist() == library.encode(t)


def test_a_worker_holds_the_chunks_of_a_run_of_texts_only(library, model, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(sentencepiece_codec, "RUN_CHARS", 200, raising=False)
    texts = [f"w{i}x w{i}y w{i}z" for i in range(300)] + [None, "", "q" * 500]
    codec = sentencepiece_codec.Codec(model)
    ids, starts = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [library.encode(t or "") for t in texts]
    assert len(codec.known) < 300 and codec.encode([])[1].tolist() == [0]


def test_encode_and_decode_tables(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, None), (3, "a▁b"), (3, "a▁b"), (99, "word " * 30_000)]
    encoded = sentencepiece_codec.encode(docs_of(rows), carry=("doc_id", "size"))
    got = encoded.collect()
    assert len(got) == len(rows) and [r.doc_id for r in got if not r.round_trip] == [3, 3]
    assert all(r.n_tokens == len(r.ids) for r in got)
    texts = {r.doc_id: r.text for r in sentencepiece_codec.decode(encoded).collect() if r.doc_id not in (3, None)}
    assert texts == {i: t for i, t in rows if i not in (3, None)}
    assert sentencepiece_codec.encode(docs_of([])).count() == 0


# token counts


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.load_ranks())


@pytest.mark.parametrize("block", [2, 64])
def test_counts_after_edits_are_those_of_the_new_text(counter, monkeypatch, block):
    monkeypatch.setattr(token_counts, "BLOCK", block)
    rng = random.Random(block)
    letters = "abc 'srelvdm 12.,!\n\t  éß日"
    for text in random_texts(block, 250, letters):
        tree = next(iter(token_counts.trees(counter, [text])))
        for _ in range(6):
            start, length, new = rng.randint(-2, len(tree.text) + 3), rng.choice([0, 1, 3, 20, 200]), random_texts(rng.random(), 1, letters)[0][: rng.choice([0, 1, 2, 10, 80])]
            at = max(0, min(start, len(tree.text)))
            want = tree.text[:at] + new + tree.text[at + length :]
            tree.edit(counter, start, length, new)
            assert tree.text == want and tree.total == len(counter.encoding.encode_ordinary(want))
            assert [len(t) for t in counter.split(want)] == tree.chars.tolist() and tuple(tree.nodes[1, :2]) == (len(tree.chars), len(want))


def test_an_edit_of_a_long_text_encodes_little(counter):
    text = "Some plain words, again and again. " * 5000
    tree = next(iter(token_counts.trees(counter, [text])))
    tree.edit(counter, 90_000, 5, "other")
    assert tree.recoded < 20 and tree.total == len(counter.encoding.encode_ordinary(tree.text))


def test_count_tokens_tables(spark, docs_of, counter):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, None), (2, "dup dup"), (2, "dup dup")]
    got = token_counts.count_tokens(token_counts.revision(docs_of(rows))).collect()
    assert len(got) == len(rows)
    want = sorted(len(counter.encoding.encode_ordinary(t or "")) for _, t in rows)
    assert sorted(r.n_tokens for r in got) == want and all(r.n_recoded > 0 for r in got)
    plain = token_counts.count_tokens(docs_of(rows)).collect()
    assert all(r.n_tokens_edited == r.n_tokens and r.n_recoded == 0 for r in plain)
    odd = spark.createDataFrame([(1, "abc def", [None, (None, None, None), (4, 100, "x")])], "doc_id long, text string, edits array<struct<start:int,length:int,text:string>>")
    assert token_counts.count_tokens(odd).collect()[0].n_tokens_edited == len(counter.encoding.encode_ordinary("abc x"))
    assert token_counts.count_tokens(docs_of([])).count() == 0


def test_trees_are_kept_as_rows(spark, docs_of, counter):
    """Edits applied in two jobs, the trees a table in between, count like the final text and encode little."""
    rng = random.Random(14)
    rows = [(i, t) for i, t in enumerate([None, "", "one two three", *random_texts(6, 20, "abc dé.,12\n'")])] + [(50, "many words here " * 4000)]
    trees = token_counts.tree_table(docs_of(rows))
    now = {i: t or "" for i, t in rows}
    for _ in range(2):
        edits = {i: [(rng.randint(0, len(t)), rng.randint(0, 5), rng.choice(["", "new ", "x1", "'s"]))] for i, t in now.items()}
        table = spark.createDataFrame([(i, [dict(zip(("start", "length", "text"), x)) for x in e]) for i, e in edits.items()], f"doc_id long, edits {token_counts.EDIT_TYPE}")
        trees = token_counts.apply_edits(trees.join(table, "doc_id"))
        now = {i: t[: edits[i][0][0]] + edits[i][0][2] + t[edits[i][0][0] + edits[i][0][1] :] for i, t in now.items()}
    got = {r.doc_id: r for r in trees.collect()}
    for i, t in now.items():
        words = counter.split(t)
        assert (got[i].text, got[i].chars, got[i].n_tokens) == (t, [len(w) for w in words], int(counter.counts(words).sum()))
    assert got[50].n_recoded < 20 and token_counts.tree_table(docs_of([])).count() == 0
