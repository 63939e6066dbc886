from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import suffix


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array(text):
    assert suffix.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_repeats():
    for text in ([1] * 200, [1, 2] * 100, [2, 1] * 100, [3, 1, 2, 1] * 60, list(range(100, 0, -1))):
        assert suffix.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def slow(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        x = (t or "").encode()
        gone = [False] * len(x)
        for k in range(len(x) - length + 1):
            if x[k : k + length] in seen:
                gone[k : k + length] = [True] * length
            seen.add(x[k : k + length])
        out[i] = (len(x), sum(gone), bytes(b for b, g in zip(x, gone, strict=True) if not g))
    return out


def check(docs, rows, length):
    found = suffix.suffix_dedup(docs, length=length).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in found} == slow(rows, length)
    for r in found:
        assert sum(b - a for a, b in r.spans) == r.n_removed
        assert all(a < b for a, b in r.spans) and all(x[1] < y[0] for x, y in zip(r.spans, r.spans[1:], strict=False))


def test_matches_brute_force(unique, unique_rows):
    check(unique, [r[:2] for r in unique_rows], 100)


def test_other_lengths(unique, unique_rows):
    check(unique, [r[:2] for r in unique_rows], 33)
    check(unique, [r[:2] for r in unique_rows], 127)


def test_small_blocks(unique, unique_rows, monkeypatch):
    monkeypatch.setattr(suffix.B, "write_blocks", lambda *a, f=suffix.B.write_blocks, **b: f(*a, **b | {"size": 1500}))
    check(unique, [r[:2] for r in unique_rows], 100)


def test_small_parts(unique, unique_rows, monkeypatch):
    monkeypatch.setattr(suffix, "PART_SYMBOLS", 20)
    check(unique, [r[:2] for r in unique_rows], 100)


def test_memory_of_a_shard_that_repeats_wholly(monkeypatch):
    """40,000 records of 150 bytes in ten copies of each: parts of about 25,000 symbols, one after another."""
    import tracemalloc

    monkeypatch.setattr(suffix, "PART_SYMBOLS", 25_000)
    rng = random.Random(15)
    strings = [rng.randbytes(150) for _ in range(40_000)]
    rows = []
    for block in range(10):
        whole = {"string": strings, "lead": [60] * len(strings), "count": [51] * len(strings), "doc": [block] * len(strings), "pos": range(len(strings))}
        table = suffix.pa.table({k: suffix.pa.array(v, t) for (k, v), t in zip(whole.items(), (suffix.pa.binary(), *["uint8"] * 2, *["int64"] * 2), strict=True)})
        rows.append({"block": block, "payload": suffix.B.pack(table)})
    tracemalloc.start()
    masks = suffix._shard(rows, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not any(masks[0]) and len(masks[0]) == 12 * len(strings)
    full = suffix.np.packbits(suffix.np.arange(96) < 51).tobytes()
    assert all(m == full * len(strings) for m in masks[1:])
    assert peak < 160e6  # 96 bytes a record, and a part; all in one array would take over 700 MB


def test_random_overlaps(spark):
    rng = random.Random(9)
    pool = ["".join(rng.choice("ab ") for _ in range(300)) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [p[(a := rng.randrange(200)) : a + rng.randrange(40, 300)] for p in rng.sample(pool, 3)]
        rows.append((i, "".join(parts)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, 100)


def hot_rows(n):
    """A line of 60 bytes in n surroundings of its own, and in some that repeat."""
    rng = random.Random(12)
    own = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    line = own(60)
    texts = [own(90) + line + own(90) for _ in range(n)]
    around = [(own(50), own(50)) for _ in range(3)]
    texts += [own(30) + (a := rng.choice(around))[0] + line + a[1] + own(30) for _ in range(20)]
    return list(enumerate(texts))


def test_hot_anchor_in_surroundings_of_its_own(spark, monkeypatch):
    rows = hot_rows(10_000)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, 100)
    monkeypatch.setattr(suffix, "HOT", 5)
    rows = hot_rows(100)
    for length in (33, 100):
        check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, length)


def test_hot_anchor_sends_only_what_repeats():
    rows = hot_rows(20_000)
    table = suffix.pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    payload = suffix.B.pack(table) + suffix.B.pack(suffix._anchors(table, 100))

    def bits(x):
        return suffix.np.packbits(x).tobytes()

    def records(most):
        b = suffix._Block(payload, 100)
        given = [[{"n": len(b.keys), "payload": bits(b.copies > 1) + bits(b.copies > most)}]]
        b.hot(given[0])
        b.records([*given, [{"n": len(b.hot_keys), "payload": bits(b.hot_copies > 1)}]])
        return int(suffix.np.unique(b.key[~b.copy], return_counts=True)[1].max())  # of one anchor

    assert records(1 << 30) > 2 * suffix.HOT and records(suffix.HOT) <= suffix.HOT


def test_symbols_of_zeros(spark):
    rng = random.Random(13)
    rows = [(i, "".join(rng.choice("\0\0\0\0a") for _ in range(rng.randrange(400)))) for i in range(60)]
    for length in (33, 100):
        check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, length)


def test_repeated_rows_and_null_ids(edge, edge_rows):
    found = suffix.suffix_dedup(edge).collect()
    assert len(found) == len(edge_rows)
    twice = sorted(r.n_removed for r in found if r.doc_id == 13)
    text = next(r[1] for r in edge_rows if r[0] == 13)
    assert len(twice) == 2 and twice[1] == len(text.encode()) and twice[0] < twice[1]
    assert {r.n_removed for r in found if r.doc_id is None} == {0, len(edge_rows[-2][1].encode())}


def test_empty(nothing):
    assert suffix.suffix_dedup(nothing).count() == 0
