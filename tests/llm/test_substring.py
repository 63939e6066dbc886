from __future__ import annotations

import collections
import re

from millrace.llm import substring

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def slow(rows, window):
    docs = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    seen = collections.Counter(tuple(w[k : k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def check(docs, rows, window):
    found = substring.substring_dedup(docs, window=window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in found), key=str) == slow([r[:2] for r in rows], window)
    for r in found:
        assert sum(b - a for a, b in r.spans) == r.n_removed


def test_matches_brute_force(edge, edge_rows):
    check(edge, edge_rows, 35)


def test_other_windows(edge, edge_rows):
    check(edge, edge_rows, 10)
    check(edge, edge_rows, 3)


def test_small_blocks_and_carried_columns(unique, unique_rows, monkeypatch):
    monkeypatch.setattr(substring.B, "write_blocks", lambda *a, f=substring.B.write_blocks, **b: f(*a, size=2000, **b))
    found = substring.substring_dedup(unique, carry=("lang", "text"), keep_layout=True).collect()
    expected = {i: (n, k) for i, n, k, _ in slow([r[:2] for r in unique_rows], 35)}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in found} == expected
    by_id = {r[0]: r for r in unique_rows}
    for r in found:
        assert (r.c0, r.c1) == (by_id[r.doc_id][2], by_id[r.doc_id][1])
        if not r.n_removed:
            assert r.text == (by_id[r.doc_id][1] or "")


def test_no_unverified_hash_removes_words(spark, monkeypatch):
    # two words of 16 bytes that a plain 64-bit hash of this library confuses
    same = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([*same, "harmlessdocument"])), (2, " ".join([*same, "ffeTifUzqW4kBQrl"]))]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 35)
    raw = [r[1].encode() for r in rows]
    monkeypatch.setattr(substring.B, "hash_spans", lambda data, starts, length, f=substring.B.hash_spans: f(data, starts, length) & 7)
    _, ends = substring.B.word_hashes(raw)
    digests = substring._full(raw, ends, substring._starts(ends, 35), 35, b"key")
    assert len(digests) == 2 and (digests[0] != digests[1]).all()


def test_few_bits_of_hashes_remove_no_other_words(unique_rows, monkeypatch):
    raw = [(r[1] or "").encode() for r in unique_rows]
    monkeypatch.setattr(substring.B, "hash_spans", lambda data, starts, length, f=substring.B.hash_spans: f(data, starts, length) & 7)
    hashes, ends = substring.B.word_hashes(raw)
    answers = []
    for _ in substring._levels(35):
        kind, keys, _, multi = substring._climb(raw, hashes, ends, 35, answers, b"key")
        assert kind == "ask"
        answers.append([{"n": len(keys), "payload": substring.np.packbits(multi).tobytes()}])
    kind, alive, _, _ = substring._climb(raw, hashes, ends, 35, answers, b"key")
    starts = substring.np.flatnonzero(alive)
    removed = {w for s in starts.tolist() for w in range(s, s + 35)}
    by_id = {i: gone for i, _, gone, _ in slow([r[:2] for r in unique_rows], 35)}
    got = [sum(1 for w in removed if ends[i] <= w < ends[i + 1]) for i in range(len(raw))]
    assert got == [by_id[r[0]] for r in unique_rows]


def test_empty(nothing):
    assert substring.substring_dedup(nothing).count() == 0
