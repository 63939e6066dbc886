from __future__ import annotations

import base64

import public_tokenizers
import pytest
import tiktoken

from millrace.llm import bpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding():
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_matches_the_library_and_decodes(edge, edge_rows):
    library = encoding()
    encoded = bpe.encode(edge, VOCABULARY, public_tokenizers.PATTERN)
    found = bpe.decode(encoded, VOCABULARY).collect()
    expected = [(r[0], library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in edge_rows]
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in found), key=str) == sorted(expected, key=str)


def test_small_blocks(unique, unique_rows, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 3000)
    library = encoding()
    found = bpe.encode(unique, VOCABULARY, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: list(r.ids) for r in found} == {r[0]: library.encode_ordinary(r[1] or "") for r in unique_rows}


def test_special_strings_are_ordinary(spark):
    text = "a<|endoftext|>b"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ids = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN).first().ids
    assert 50256 not in ids and list(ids) == encoding().encode_ordinary(text)


def test_nulls_and_unknown_ids(spark, nothing):
    ids = spark.createDataFrame([(1, None), (2, []), (3, [72, 105])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(ids, VOCABULARY).collect()}
    assert got[1] is None and got[2] == b"" and len(got[3]) == 2
    with pytest.raises(Exception, match="KeyError"):
        bpe.decode(spark.createDataFrame([(1, [99_999])], "doc_id long, ids array<int>"), VOCABULARY).collect()
    assert bpe.encode(nothing, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_only_blank_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    found = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in found) == [(1, []), (2, [])]
