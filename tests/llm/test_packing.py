from __future__ import annotations

import collections
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing, tokens
from millrace.llm.tokens import Encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def ids(text):
    library = Tokenizer.from_file(TOKENIZER)
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_matches_the_library(edge_rows):
    texts = [r[1] for r in edge_rows] + [" ", "  a", "a ", "a \n b", " <|endoftext|> x", "\x1c a \x1f b", "a b  c", "　 x"]
    encoder = Encoder(TOKENIZER)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [ids(t) for t in texts]
    assert encoder.pieces


@pytest.mark.parametrize("kept, slots, run", [(1 << 23, 16, 1 << 21), (2000, 8, 300), (50, 6, 1 << 12)])
def test_encoder_of_odd_spaces(monkeypatch, kept, slots, run):
    monkeypatch.setattr(tokens, "KEPT", kept)
    monkeypatch.setattr(tokens, "SLOTS", slots)
    monkeypatch.setattr(tokens, "RUN", run)
    rng = random.Random(3)
    parts = [*"ab  \n\t'sé日,.!1²\xa0\u2003\u3000\x85\x1c-", "the ", "and ", "'re", "\u200b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(5000)]
    encoder = tokens.Encoder(TOKENIZER)
    found = encoder.library.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [e.ids for e in found]


def test_no_hash_decides_an_id(monkeypatch):
    # two words of 16 bytes that a 64-bit hash of this library confuses, and longer ones that begin alike
    texts = ["x harmlessdocument y ffeTifUzqW4kBQrl z", "a harmlessdocumentation harmlessdocumentatioN b" + " ab\0 ab ab\0\0" * 3]
    encoder = Encoder(TOKENIZER)
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [ids(t) for t in texts]
    monkeypatch.setattr(tokens, "mix", lambda a, b: np.zeros(len(a), dtype=np.uint64))
    encoder, rng = Encoder(TOKENIZER), random.Random(5)
    texts += [" ".join(rng.choice("ab") * rng.randrange(1, 40) for _ in range(200)) for _ in range(20)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [ids(t) for t in texts]


def test_strings_of_added_tokens_are_encoded_as_the_library_does():
    texts = ["ab <|endoftext|> cd", "<|endoftext|>", "a<|endoftext|>b c d", "no such token"]
    found = [np.frombuffer(x, "<u4").tolist() for x in Encoder(TOKENIZER).encode(texts)]
    assert found == [ids(t) for t in texts] and 50256 in found[0]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "RUN", 1 << 16)
    encoder = Encoder(TOKENIZER)
    assert sum(x.nbytes for x in (encoder.low, encoder.high, encoder.length, encoder.start, encoder.size, encoder.ids)) < 72 << 20
    rng = random.Random(6)
    for _ in encoder.encode(" ".join("%030x" % rng.getrandbits(120) for _ in range(3000)) for _ in range(10)):
        assert len(encoder.long) <= tokens.KEPT_LONG + 3000


def test_plan_places_everything():
    rng = random.Random(6)
    for capacity in (10, 64, 2048):
        counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 500) for _ in range(capacity // 2)}
        bins, got = packing.plan(counts, capacity), collections.Counter()
        for pattern, times in bins:
            assert sum(pattern) <= capacity and times > 0
            for x in pattern:
                got[x] += times
        assert got == counts
        used = sum(t for _, t in bins)
        assert used >= -(-sum(x * n for x, n in counts.items()) // capacity)
    assert packing.plan({}) == []


def test_two_documents_replace_the_smallest():
    # 6 + 3 leaves a gap of 1; 2 and 2 fill the 4 that is free without the 3
    bins = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    assert sorted(bins[0][0]) == [2, 2, 6] and bins[1] == ([3], 1)


def check(docs, rows, capacity):
    found = packing.pack(docs, TOKENIZER, capacity=capacity).collect()
    expected = []
    for r in rows:
        own = [*ids(r[1]), 0]
        first = len(own) if len(own) <= capacity else len(own) % capacity or capacity
        cuts = [0, *range(first, len(own) + 1, capacity)] if len(own) > capacity else [0, len(own)]
        expected += [(r[0], k, a, own[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = [(r.doc_id, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    bins = collections.defaultdict(list)
    for r in found:
        assert r.length == len(r.ids) // 4 <= capacity
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_many_tasks_and_lengths_are_joined_by_shuffle(edge, edge_rows, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    check(edge, edge_rows, 50)


def test_whole_table(edge, edge_rows):
    total = sum(len(ids(r[1])) + 1 for r in edge_rows)
    assert check(edge, edge_rows, 2048) <= -(-total // 2048) + 1
    check(edge, edge_rows, 50)


def test_empty(nothing):
    assert packing.pack(nothing, TOKENIZER).count() == 0
