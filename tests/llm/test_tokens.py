from __future__ import annotations

import os
import random

import pytest

from measura.llm.bpe import PATTERN, PieceBpe, SegmentTreeBpe, WordBpe, decoded, encode_corpus, token_count, vocabulary_path
from measura.llm.packing import Packer, pack, split_sizes

pytestmark = pytest.mark.skipif(not os.path.exists(vocabulary_path()), reason="no vocabulary files")


@pytest.fixture(scope="module")
def bpe():
    return SegmentTreeBpe.load(vocabulary_path())


def slow(piece, ranks):
    """Merge the leftmost pair of least rank, one at a time."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_pieces_against_brute_force(bpe):
    rng = random.Random(1)
    for _ in range(400):
        piece = bytes(rng.choice(b" abcdehilnorstuE!\xc3\xa9\xe6") for _ in range(rng.randint(1, 30)))
        assert list(bpe.encode_piece(piece)) == slow(piece, bpe.ranks)


def test_against_the_public_library(bpe):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary_path(name="byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n\r\té日 ,.1's​\x1c\x85") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "don't\n\nstop  \n now", "a" * 3000, "<|endoftext|>", " \n \r\n x\r\ny"]
    assert [bpe.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def _texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n\r\tÉé日 ,.1's​\x1cΣς🙏<▁") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    return [*texts, "", "Don't  STOP\n now", "a" * 500, "<|endoftext|> <s> </s> <unk> <0x0A>", "İstanbul ΟΔΟΣ", " " * 40 + "x", "The river runs past the tin roof; наш путь, 銅のランプ"]


def test_the_other_vocabularies_against_their_libraries():
    tiktoken, tokenizers, sentencepiece = (pytest.importorskip(m) for m in ("tiktoken", "tokenizers", "sentencepiece"))
    texts, at = _texts(), lambda name: vocabulary_path(name=name)
    many = SegmentTreeBpe.load(at("byte_bpe_multi_50k.tiktoken"))
    public = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=many.ranks, special_tokens={})
    assert [many.encode(t) for t in texts] == [public.encode_ordinary(t) for t in texts]
    words = tokenizers.Tokenizer.from_file(at("word_bpe_49k.json"))
    words.encode_special_tokens = True
    own = WordBpe.load(at("word_bpe_49k.json"))
    assert [own.encode(t) for t in texts] == [e.ids for e in words.encode_batch(texts, add_special_tokens=False)]
    pieces = sentencepiece.SentencePieceProcessor(model_file=at("piece_bpe_32k.model"))
    own = PieceBpe.load(at("piece_bpe_32k.model"))
    assert [own.encode(t) for t in texts] == pieces.encode(texts, num_threads=1)


def test_corpus_round_trip_nulls_and_repeats(spark):
    rows = [(1, "It's raining\non the tin roof", "x"), (2, None, "y"), (3, "", None), (1, "It's raining\non the tin roof", "x"), (4, "é日" * 500, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_corpus(df)
    got = out.withColumn("back", decoded("ids")).collect()
    assert sorted((r.doc_id, r.back) for r in got) == sorted((i, t or "") for i, t, _ in rows)
    assert {r.doc_id: len(r.ids) for r in got} == {r.doc_id: r.n for r in df.select("doc_id", token_count("text").alias("n")).collect()}
    assert encode_corpus(df.limit(0)).count() == 0


def test_packer_fills_the_fullest_window_with_room():
    p = Packer(10, 2)
    assert [p.place(n) for n in (6, 3, 4, 1)] == [0, 0, 1, 0]
    assert split_sizes(25, 10) == [(0, 10), (10, 20), (20, 25)] and split_sizes(10, 10) == [(0, 10)]


def test_containers_hold_everything_once(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 5, 40, 99, 100, 101, 350])) for i in range(3000)] + [(5000, None), (None, 7)]
    items = spark.createDataFrame(rows, "k long, size int").repartition(6)
    out = pack(items, "k", "size", [("a", 100), ("b", 1000)], windows=8, fan_in=4).collect()
    for name, cap in (("a", 100), ("b", 1000)):
        mine = [r for r in out if r.pack_name == name]
        fill, whole = {}, {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.to_unit - r.from_unit
            whole.setdefault(r.k, []).append((r.piece_ix, r.from_unit, r.to_unit))
        assert max(fill.values()) <= cap
        for k, n in rows:
            parts = sorted(whole[k])
            assert sum(b - a for _, a, b in parts) == (n or 0) and (len(parts) == 1 or n > cap)
        assert sum(fill.values()) / (len(fill) * cap) > 0.9
    assert pack(items.limit(0), "k", "size", [("a", 10)]).count() == 0
    with pytest.raises(ValueError):
        pack(items, "k", "size", [("a", 0)])
