from __future__ import annotations

import collections
import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from millrace.llm import alignment, queries
from tests.llm.conftest import rows_of, texts

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def byte_tables():
    """The bytes of each token: of A by decoding through the library's own table, of B by its pieces."""
    library = Tokenizer.from_file(A)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            of[chr(256 + extra)] = b
            extra += 1
    a = {i: bytes(of[c] for c in t) for t, i in library.get_vocab().items()}
    sp = SentencePieceProcessor(model_file=B)
    b = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        b[i] = bytes.fromhex(p[3:5]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">") else p.replace("▁", " ").encode()
    return a, b


def slow(docs):
    """Whole texts, all pairs of tokens near each other compared."""
    library, sp, (a_of, b_of) = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), byte_tables()
    library.encode_special_tokens = True
    rows, counts = [], collections.Counter()
    for doc, text in docs:
        raw = f" {text or ''}".encode()
        a = library.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        if not text or b"".join(a_of[i] for i in a) != raw or b"".join(b_of[i] for i in b) != raw:
            rows.append((doc, [], [], [], []))
            continue

        def spans(ids, of):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(of[i]), i))
                at += len(of[i])
            return out

        sa, sb = spans(a, a_of), spans(b, b_of)
        links, j = [], 0
        for s, e, i in sa:
            while j < len(sb) and sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                links.append((i, sb[k][2]))
                k += 1
        both = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
        groups, lo = [], 0
        for cut in both:
            groups.append(tuple(",".join(str(i) for s, e, i in x if lo < e <= cut) for x in (sa, sb)) if len(both) < 400 else None)
            lo = cut
        if len(both) >= 400:
            groups, own = [], [collections.deque(sa), collections.deque(sb)]
            for cut in both:
                group = []
                for x in own:
                    ids = []
                    while x and x[0][1] <= cut:
                        ids.append(str(x.popleft()[2]))
                    group.append(",".join(ids))
                groups.append(tuple(group))
        counts.update(links)
        rows.append((doc, a, b, groups, links))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for doc, a, b, groups, links in rows:
        best = sum(counts[x] == most[x[1]] for x in links)
        text = ";".join("|".join(g) for g in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), sha))
    return out, counts, most


def awkward():
    rng = random.Random(3)
    out = [" lead", "trail ", "two  spaces", "  ", "\n", "a \n b", "a b   c", "x \x1c y", "▁", "a ▁b", "\x00 a", "ﬁ Å", "\u0085 \u0085"]
    out += ["<|endoftext|>", "a <|endoftext|> b", "<s> </s> <unk> <0x41>", "I'll we've 'tis", "日本語 のテキスト", "\U0001f600\U0001f468‍\U0001f469", "\r\n\r\n {\r\n}"]
    alphabet = [" ", " ", " ", "a", "b", "the", "ing", "\n", "\t", "é", "ß", "\U0001f600", "1", "12", ".", "'s", " ", " ", "\r", "一", "\x1f", "▁"]
    out += ["".join(rng.choices(alphabet[: rng.choice([7, 12, 21, 22])], k=rng.randrange(1, 40))) for _ in range(400)]
    return out


def table(spark, values):
    schema = "doc_id long, text string, a string, b string, n long, block long, place long, unit string, k int, best int, counts long, `a.b` string"
    return spark.createDataFrame(rows_of(values), schema).repartition(3)


@pytest.mark.parametrize("own", [False, True])
def test_query_against_brute_force(spark, own, tmp_path):
    folder = "/root/testdata/sf0.001"
    if own:
        folder = f"file://{tmp_path}"
        table(spark, texts() + awkward()).write.parquet(f"{folder}/documents.parquet")
    found = queries.op13_tokenizer_alignment(spark, folder)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    expected, _, _ = slow(docs)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert sum(r[1] == 0 for r in expected) < len(expected) / 2


def test_pairs_and_small_slices(spark, monkeypatch):
    values = texts()[:40] + awkward()[:60]
    monkeypatch.setattr(alignment, "TOKENS", 5)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(alignment, "ENCODED", 7)
    monkeypatch.setattr(alignment, "RUN", 3)
    _, counts, most = slow(list(enumerate(values)))
    docs = table(spark, values)
    found = {(r.a, r.b): (r.n, r.best) for r in alignment.pair_counts(docs, A, B).collect()}
    assert found == {x: (n, n == most[x[1]]) for x, n in counts.items()}


def test_nulls_repeats_and_empty(spark, edge, edge_rows, nothing):
    found = alignment.align(edge, A, B).drop("groups").collect()
    expected, _, _ = slow([r[:2] for r in edge_rows])
    key = lambda rows: sorted(rows, key=str)
    assert key(map(tuple, found)) == key(r[:-1] for r in expected)
    assert alignment.align(nothing, A, B).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert {tuple(r)[1:] for r in alignment.align(blank, A, B).collect()} == {(0, 0, 0, 0, 0, 0, "")}
    assert alignment.pair_counts(blank, A, B).count() == 0
