from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import rangecoder, tokenio, tokens
from millrace.llm.scratch import new_path
from millrace.llm.tokens import Encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2**30 - 1)), max_size=300))
def test_round_trip(ids):
    assert rangecoder.decode(rangecoder.encode(np.array(ids, dtype=np.uint32))).tolist() == ids


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 16384, 16385, 40000])
def test_round_trip_of_blocks(n):
    rng = np.random.default_rng(n)
    for ids in (np.zeros(n), rng.integers(0, 50257, n), np.minimum(rng.zipf(1.3, n), 50000), np.arange(n) % 7, np.full(n, 2**30 - 1)):
        ids = ids.astype(np.uint32)
        coded = rangecoder.encode(ids)
        assert (rangecoder.decode(coded) == ids).all()
    if n > 4000:
        assert len(rangecoder.encode(np.arange(n) % 7)) < n / 8


def test_blocks_are_independent():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50257, 3 * rangecoder.BLOCK).astype(np.uint32)
    other = ids.copy()
    other[: rangecoder.BLOCK] = np.sort(ids[: rangecoder.BLOCK])  # the same distinct ids, which the header lists
    a, b = rangecoder.encode(ids), rangecoder.encode(other)
    assert a != b and a[-50_000:] == b[-50_000:]


def test_smaller_than_plain_order_0_and_zlib(sf_ids):
    n = np.bincount(sf_ids)
    share = n[n > 0] / len(sf_ids)
    static = -(share * np.log2(share)).sum()  # without its table
    step = rangecoder.BLOCK
    plain = sum(len(zlib.compress(sf_ids[i : i + step].astype("<u2").tobytes(), 9)) for i in range(0, len(sf_ids), step))
    coded = rangecoder.encode(sf_ids)
    assert (rangecoder.decode(coded) == sf_ids).all()
    bits = 8 * len(coded) / len(sf_ids)
    assert bits < static - 0.3 and bits < 8 * plain / len(sf_ids) - 1


def test_orders_1_and_2_are_mixed_in():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 3000, 400)
    ids = np.concatenate([base[(a := rng.integers(0, 300)) : a + 100] for _ in range(160)])  # known once seen
    alone = rng.permutation(ids)
    assert len(rangecoder.encode(ids)) < len(rangecoder.encode(alone)) / 3


@pytest.fixture(scope="module")
def sf_ids():
    """The ids of the documents of sf0.01, as they are written."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet").sort_by("doc_id")
    coded = Encoder(TOKENIZER).encode(table.column("text").to_pylist())
    return np.concatenate([np.append(np.frombuffer(x, "<u4"), 0) for x in coded]).astype(np.uint32)


def test_many_distinct_ids():
    rng, size = np.random.default_rng(3), 5_000_000
    ranks = rng.integers(0, size, (20, 2)).astype(np.uint32)
    count, words = rangecoder._encode_lanes(ranks, size)
    assert (rangecoder._decode_lanes(words, count, 20, size) == ranks).all()
    ids = rng.choice(1 << 30, 70_000, replace=False).astype(np.uint32)
    assert (rangecoder.decode(rangecoder.encode(ids)) == ids).all()


def test_damage_is_found():
    coded = bytearray(rangecoder.encode(np.arange(5000) % 1000))
    coded[-900] ^= 4
    with pytest.raises(ValueError, match="damaged"):
        rangecoder.decode(bytes(coded))
    with pytest.raises(ValueError, match="not a token block"):
        rangecoder.decode(b"nothing")
    with pytest.raises(ValueError, match="below"):
        rangecoder.encode(np.array([2**31]))


def expected(rows):
    library = Tokenizer.from_file(TOKENIZER)
    out, start = [], 0
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, ids))
        start += len(ids)
    return out


def test_file_holds_everything_in_order(spark, unique, unique_rows, monkeypatch):
    monkeypatch.setattr(tokenio, "CHUNK", 500)
    path = new_path(spark, "tokens")
    tokenio.write_token_file(unique, path, TOKENIZER)
    found = tokenio.read_token_file(spark, path).collect()
    got = sorted((r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in found)
    assert got == expected(unique_rows)


def test_null_ids_come_last_and_repeats_stay(spark, edge, edge_rows):
    path = new_path(spark, "tokens")
    tokenio.write_token_file(edge, path, TOKENIZER)
    found = tokenio.read_token_file(spark, path).collect()
    key = lambda rows: sorted(((i, len(x)) for i, _, x in rows), key=str)
    assert key((r.doc_id, 0, r.ids[::4]) for r in found) == key(expected(edge_rows))
    assert min(r.start for r in found if r.doc_id is None) > max(r.start for r in found if r.doc_id is not None)


def test_empty(spark, nothing):
    path = new_path(spark, "tokens")
    tokenio.write_token_file(nothing, path, TOKENIZER)
    assert tokenio.read_token_file(spark, path).count() == 0


def test_any_range_is_decoded_from_its_own_blocks(monkeypatch):
    rng = np.random.default_rng(8)
    ids = np.minimum(rng.zipf(1.3, 5000), 3000).astype(np.uint32)
    monkeypatch.setattr(rangecoder, "LANES", 3)
    coded = rangecoder.encode(ids, 300)
    for start, stop in [(0, 5000), (0, 1), (4999, 9000), (299, 301), (900, 1800), (1234, 2345), (7, 7), (6000, 7000), (-5, 3)]:
        assert (rangecoder.decode_range(coded, start, stop) == ids[max(0, start) : max(0, stop)]).all()
    damaged = bytearray(coded)
    damaged[-60] ^= 255  # of the last block
    assert (rangecoder.decode_range(bytes(damaged), 0, 4500) == ids[:4500]).all()
    with pytest.raises(ValueError, match="block 16 is damaged"):
        rangecoder.decode_range(bytes(damaged), 4900, 4950)


def test_ranges_of_a_file(spark, unique, monkeypatch):
    monkeypatch.setattr(tokenio, "CHUNK", 4000)
    path = new_path(spark, "tokens")
    tokenio.write_token_file(unique, path, TOKENIZER)
    whole = sorted((r.start, bytes(r.ids)) for r in tokenio.read_token_file(spark, path).collect())
    raw = b"".join(ids for _, ids in whole)
    n = len(raw) // 4
    for start, stop in [(0, n), (0, 5), (n - 3, n + 9), (n // 3, n // 2), (n, n + 1)]:
        found = sorted((r.start, bytes(r.ids)) for r in tokenio.read_range(spark, path, start, stop).collect())
        assert b"".join(ids for _, ids in found) == raw[4 * start : 4 * stop]
        assert [s for s, _ in found] == [start + sum(len(x) // 4 for _, x in found[:i]) for i in range(len(found))]


def test_small_parts_go_in_many_lanes(spark):
    """A part of few ids costs by its ids: its steps are not those of a whole block."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"word{x}" for x in rng.integers(0, 500, 400))) for i in range(60)]
    path = new_path(spark, "tokens")
    tokenio.write_token_file(spark.createDataFrame(rows, "doc_id long, text string"), path, TOKENIZER)
    parts = spark.read.parquet(path).collect()
    assert max(r.n_ids for r in parts) > 4 * rangecoder.SHORT
    for r in parts:
        lanes, block = np.frombuffer(r.blocks, "<u4", 2, 4).tolist()
        assert block == rangecoder.SHORT and lanes == -(-r.n_ids // block)
    found = tokenio.read_token_file(spark, path).collect()
    assert sorted((r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in found) == expected(rows)


def test_block_lengths():
    n = [0, 1, 40_000, 65_536, 100_000, 1 << 20, 1 << 23]
    assert [rangecoder.block_for(x) for x in n] == [1024, 1024, 1024, 1024, 1563, 16384, 16384]


def test_long_blocks_go_in_few_steps(monkeypatch):
    """A step of the coder costs by its calls: the ways of a long block share it, in both directions, and the model."""
    rng, steps = np.random.default_rng(9), []
    ids = np.minimum(rng.zipf(1.3, 3 * rangecoder.BLOCK - 5), 50000).astype(np.uint32)
    predict = rangecoder._Model.predict
    monkeypatch.setattr(rangecoder._Model, "predict", lambda self: (steps.append(1), predict(self))[1])
    coded = rangecoder.encode(ids)
    assert (rangecoder.decode(coded) == ids).all()
    assert 0 < len(steps) <= 2 * rangecoder.BLOCK // 16


@pytest.mark.parametrize("block", [1, 2, 511, 1024, 1025, 1563, 5000, 16383, 16384])
def test_ways_of_any_block(block):
    rng = np.random.default_rng(block)
    n = min(3 * block + block // 3 + 1, 40_000)
    for ids in (np.minimum(rng.zipf(1.2, n), 3000), np.zeros(n), np.arange(n) % 40, rng.integers(0, 60_000, n)):
        ids = ids.astype(np.uint32)
        coded = rangecoder.encode(ids, block)
        assert (rangecoder.decode(coded) == ids).all()
        for start, stop in [(0, 1), (block - 1, block + 1), (n // 2, n // 2 + 3), (n - 1, n)]:
            assert (rangecoder.decode_range(coded, start, stop) == ids[max(0, start) : stop]).all()


def test_short_words_for_very_many_distinct_ids():
    rng = np.random.default_rng(5)
    ids = np.repeat(rng.choice(1 << 30, 150_000, replace=False), rng.integers(1, 3, 150_000)).astype(np.uint32)
    rng.shuffle(ids)
    assert (rangecoder.decode(rangecoder.encode(ids)) == ids).all()


def test_order_0_keeps_something_whatever_is_right():
    """Weights and places stay above zero, and within their sums, after a block in which one order is always right."""
    table = np.zeros((4, 2), dtype=np.uint32)
    model = rangecoder._Model(2, 1, 5, None, table, True)
    for right in ([1 << 22, 0, 0], [0, 1 << 22, 0], [0, 0, 1 << 22], [0, 1 << 21, 1 << 21]):
        model.credits = np.tile(np.array([(8, b, a) for a in (0, 4, 8, 16) for b in (0, 2, 4, 8)]), (2, 1))
        model.credits[[3, 15, 17]] += right
        model.weigh()
        weight = model.weight.reshape(-1, 4)[:, 0]
        assert weight.min() > 0 and (model.begin.reshape(-1, 4)[:, 0] + (weight << model.bits) == 1 << int(model.total)).all()
    model.prior = np.array([1, 1, 1 << 30, 1, 1])
    model.cumulate()
    assert (np.diff(model.cumulated) > 0).all() and (model.cumulated[:, -1] == 1 << model.bits).all()


def test_a_block_adapts_order_0():
    """Ids that a call has rarely and a block often: the block's own counts make up for it."""
    rng = np.random.default_rng(6)
    own = [100 * k + rng.integers(0, 100, rangecoder.BLOCK) for k in range(8)]
    apart, mixed = np.concatenate(own), rng.permutation(np.concatenate(own))
    assert len(rangecoder.encode(apart)) < 0.92 * len(rangecoder.encode(mixed))


def test_a_wider_memory_of_pieces_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 600)
    monkeypatch.setattr(tokens, "SLOTS", 8)
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}x" for x in rng.integers(0, 150, 50)) for _ in range(40)]
    narrow, wide = Encoder(TOKENIZER), Encoder(TOKENIZER, wider=3)
    library, fresh = Tokenizer.from_file(TOKENIZER), []
    for own in (narrow, wide):
        asked, of = [], own._fresh
        monkeypatch.setattr(own, "_fresh", lambda p, asked=asked, of=of: (asked.extend(p), of(p))[1])
        for t in texts:
            assert np.frombuffer(next(own.encode([t])), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        fresh.append(len(asked))
    assert fresh[1] < fresh[0]
