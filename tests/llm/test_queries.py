"""The registered queries, over a small table and an awkward one, against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__
from millrace.llm import bpe, langid, queries
from tests.llm import test_embdedup, test_simhash, test_substring

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["plain", "awkward"])
def folder(request, spark, unique, tmp_path_factory):
    """A folder of tables; the awkward one has nulls, blanks, copies, long texts, and columns with clashing names."""
    if request.param == "plain":
        return DATA
    path = f"file://{tmp_path_factory.mktemp('awkward')}"
    unique.withColumnRenamed("payload", "a.b").write.parquet(f"{path}/documents.parquet")
    rows = [r for r in test_embdedup.data(300) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame([(*r, 1, 2, "v", 3, 4) for r in rows], test_embdedup.SCHEMA).write.parquet(f"{path}/embeddings.parquet")
    return path


def run(spark, folder, name):
    found = next(q for n, q in __spark_entry__.queries().items() if n.startswith(name))(spark, folder)
    return found.columns, found.collect()


@pytest.fixture(scope="module")
def docs(folder):
    table = pq.read_table(f"{folder.removeprefix('file://')}/documents.parquet", columns=["doc_id", "text", "lang"])
    return sorted(zip(*table.to_pydict().values(), strict=True))


@pytest.fixture(scope="module")
def vectors(folder):
    table = pq.read_table(f"{folder.removeprefix('file://')}/embeddings.parquet", columns=["vec_id", "embedding", "label"])
    return list(zip(*table.to_pydict().values(), strict=True))


def ids(docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in docs}


def crc(x):
    return zlib.crc32(np.array(x, dtype="<u4").tobytes())


def test_op1(spark, folder, docs):
    names, found = run(spark, folder, "op1_")
    assert names[:4] == ["doc_id", "held_out", "lang_pred", "score"] and len(found) == len(docs)
    texts = {i: t for i, t, _ in docs}
    known = {lang for i, _, lang in docs if lang is not None}
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        letters = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert r.lang_pred in known if letters else r.lang_pred == "und"
    if folder == DATA:
        told = [(r.lang_pred, lang) for r in found for i, _, lang in docs if i == r.doc_id and r.held_out and lang]
        assert sum(a == b for a, b in told) > 0.95 * len(told)


def test_op2(spark, folder, vectors):
    names, found = run(spark, folder, "op2_")
    assert names[:4] == ["vec_id", "n_links", "component_id", "kept"]
    assert {r.vec_id: [(r.n_links, r.component_id)] for r in found} == test_embdedup.slow(vectors, 0.93)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_op3(spark, folder, docs):
    names, found = run(spark, folder, "op3_")
    assert names[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    of = collections.defaultdict(list)
    for r in found:
        of[r.doc_id].append(r)
    expected, tokens = ids(docs), 0
    assert set(of) == set(expected)
    for i, own in of.items():
        own.sort(key=lambda r: r.piece)
        x = expected[i]
        tokens += len(x)
        first = len(x) % 2048 or 2048
        cuts = [0, *range(first, len(x) + 1, 2048)] if len(x) > 2048 else [0, len(x)]
        pieces = [(k, a, b - a, crc(x[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == pieces
    bins = collections.defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(bins) <= 1.02 * -(-tokens // 2048) + 1


def test_op4(spark, folder, docs):
    names, found = run(spark, folder, "op4_")
    assert names[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ranks = bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for i, t, _ in docs:
        x = library.encode_ordinary(t or "")
        expected.append((i, len(x), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())))
    assert sorted(tuple(r)[:4] for r in found) == expected


def test_op5(spark, folder, docs):
    names, found = run(spark, folder, "op5_")
    assert names[:3] == ["doc_id", "fingerprint", "component_id"]
    expected = test_simhash.components([(i, test_simhash.slow(t)) for i, t, _ in docs])
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in found), key=str) == expected
    assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in found)


def test_op6(spark, folder, docs):
    names, found = run(spark, folder, "op6_")
    assert names[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    expected = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in test_substring.slow([d[:2] for d in docs], 35)]
    assert sorted((tuple(r)[:4] for r in found), key=str) == sorted(expected, key=str)


def test_op7(spark, folder, docs):
    names, found = run(spark, folder, "op7_")
    assert names[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    seen, expected = set(), []
    for i, t, _ in docs:
        x, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for k in range(len(x) - 99):
            if x[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(x[k : k + 100])
        runs = len([s for s in bytes(gone).split(b"\0") if s])
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        expected.append((i, len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    assert sorted(tuple(r)[:5] for r in found) == expected


def test_op8(spark, folder, docs):
    names, found = run(spark, folder, "op8_")
    assert names[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    start, expected = 0, []
    for i, x in sorted(ids(docs).items()):
        expected.append((i, start, len(x), crc(x)))
        start += len(x)
    assert sorted(tuple(r)[:4] for r in found) == expected


def test_op9(spark, folder, vectors):
    names, found = run(spark, folder, "op9_")
    assert names[:4] == ["query_id", "rank", "vec_id", "score"]
    size = collections.Counter(len(v) for _, v, _ in vectors if v).most_common(1)[0][0]
    ok = {i: np.array(v, dtype=np.float64) for i, v, _ in vectors if v and len(v) == size and None not in v}
    ok = {i: v for i, v in ok.items() if np.isfinite(v).all() and v.any()}
    got = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r)
    assert set(got) == {i for i in ok if i % 20 == 0}
    hits = total = 0
    for q, own in got.items():
        best = sorted((-math.fsum(v * ok[q]), i) for i, v in ok.items() if i != q)[:20]
        assert [r.rank for r in own] == list(range(1, len(best) + 1))
        assert all(math.isclose(r.score, math.fsum(ok[r.vec_id] * ok[q]), rel_tol=1e-9, abs_tol=1e-12) for r in own)
        hits += len({i for _, i in best} & {r.vec_id for r in own})
        total += len(best)
    assert hits >= 0.98 * total  # equal scores may be summed in another order


def test_op10(spark, folder, docs):
    names, found = run(spark, folder, "op10_")
    assert names == ["doc_id", "digest", "license_id", "kind"] and len(found) == len(docs)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, folder, name):
    db, path = duckdb.connect(), folder.removeprefix("file://")
    for table in ("documents", "embeddings"):
        files = f"{path}/{table}.parquet" if folder == DATA else f"{path}/{table}.parquet/*.parquet"
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{files}'")
    expected = db.execute(queries.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    found = queries.queries()[name](spark, folder)
    assert sorted(found.columns) == sorted(names)
    kinds = {"long": "BIGINT", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert [kinds[found.schema[n].dataType.simpleString()] for n in names] == [str(c[1]) for c in expected.description]
    assert sorted(map(str, expected.fetchall())) == sorted(str(tuple(r)) for r in found.select(*names).collect())


def _plain_code(x: bytes, order: int) -> int:
    code = order
    code = code * 257 ^ x[0]
    for b in x[1:]:
        code = (code ^ b) * 0x01000193 & 0xFFFFFFFF
    code ^= code >> 15
    code = code * 0x2C1B3C6D & 0xFFFFFFFF
    return (code ^ code >> 12) & (langid.BUCKETS - 1)


def _plain_grams(text: str) -> list[tuple[int, int]]:
    x = text.lower().encode()
    return [(at, _plain_code(x[k : k + n], n)) for at, n in enumerate(langid.ORDERS) for k in range(len(x) - n + 1)]


def test_language_id_by_brute_force(spark):
    """Counts, log odds, bit weights and loss-weighted decoding, one n-gram, bit and codeword after another."""
    rows = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    rows = [(r["doc_id"], r["text"][:1500], r["lang"]) for r in rows if r["lang"]]
    train, rest = rows[:60], rows[60:100]
    languages = sorted({lang for *_, lang in train})
    count = {lang: collections.Counter() for lang in languages}
    for _, text, lang in train:
        count[lang].update(_plain_grams(text))
    share = {}
    for lang in languages:
        for at in range(len(langid.ORDERS)):
            total = sum(n for (order, _), n in count[lang].items() if order == at) + 0.5 * langid.BUCKETS
            share[lang, at] = lambda c, lang=lang, at=at, total=total: (count[lang][at, c] + 0.5) / total
    code = langid.codewords(len(languages)).tolist()

    def margins(text):
        grams = _plain_grams(text)
        out = []
        for bit in range(len(code[0])):
            on, off = ([lang for i, lang in enumerate(languages) if (code[i][bit] > 0) == side] for side in (True, False))
            if not on or not off:
                out.append(0.0)
                continue
            odds = (math.log(sum(share[x, a](c) for x in on) / len(on)) - math.log(sum(share[x, a](c) for x in off) / len(off)) for a, c in grams)
            out.append(6 * sum(odds) / max(1, len(grams)))
        return out

    right = [0] * len(code[0])
    for _, text, lang in train:
        for bit, m in enumerate(margins(text)):
            right[bit] += (m > 0) - (m < 0) == code[languages.index(lang)][bit]
    weight = [2 * max(r / len(train) - 0.5, 0.01) for r in right]
    expected = {}
    for i, text, _ in rest:
        loss = []
        for word in code:
            terms = (w * math.exp(-min(8, max(-8, m * b))) for m, b, w in zip(margins(text), word, weight, strict=True))
            loss.append(sum(terms) / sum(weight))
        score = 1 / sum(math.exp(-4 * (x - min(loss))) for x in loss)
        expected[i] = (languages[loss.index(min(loss))], score)
    from pyspark.sql import functions as F

    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), "text", "lang", F.col("doc_id"))
    found = langid.identify(spark.createDataFrame(rest, "doc_id long, text string, lang string"), model).collect()
    assert len(found) == len(expected) == 40
    for r in found:
        lang, score = expected[r.doc_id]
        assert r.lang_pred == lang and math.isclose(r.score, score, rel_tol=1e-3)
