from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import queries, runs
from tests.llm.conftest import rows_of, texts, words


def least_period(w):
    """By the longest border."""
    border = [0] * len(w)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = border[k - 1]
        k += w[i] == w[k]
        border[i] = k
    return len(w) - border[-1] if w else 0


def slow(w, shortest=24, repeats=3):
    """Every stretch that no neighbour extends, by its definition."""
    found, x = set(), np.array(w, dtype=object)
    for p in range(1, len(w) // repeats + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], x[:-p] == x[p:], [0]]).astype(int)))
        for i, j in edge.reshape(-1, 2).tolist():
            if j - i + p >= max(shortest, repeats * p) and least_period(w[i : j + p]) == p:
                found.add((i, j - i + p, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def awkward():
    rng = random.Random(5)
    out = [words(rng, 30).split(), ["a"] * 23, ["a"] * 24, ["a", "b"] * 12, ["a", "b"] * 11 + ["a"], list("abcdefgh") * 3]
    out += [list("abcdefghi") * 3, list("abcdefghi") * 2 + list("abcdefgh"), [], ["x"], ["a"] * 700]
    out += [(["a"] * 30 + ["b"]) * 4, ["q", *["a", "b", "c"] * 20, *["c", "b"] * 20, *["z"] * 25, "z2"], (["a"] * 3 + ["b"]) * 50]
    for _ in range(60):  # few distinct words, so that runs touch, nest and overlap
        w = [str(rng.randrange(rng.choice([1, 2, 3, 5]))) for _ in range(rng.randrange(90))]
        p, n = rng.randrange(1, 20), rng.randrange(20, 90)
        out.append(w + ([str(rng.randrange(3)) for _ in range(p)] * n)[:n] + w[: rng.randrange(40)])
    thue = [0]
    while len(thue) < 4096:
        thue += [1 - x for x in thue]
    out.append([str(x) for x in thue + thue[:2048] + thue])  # equal sums of powers of any odd base
    return out


def together(texts_, **more):
    ends = np.cumsum([0, *map(len, texts_)])
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(x, len(numbers)) for t in texts_ for x in t], dtype=np.int64)
    found = runs.find(ids, ends, **more)
    return [[(s - a, n, p) for s, n, p in found.tolist() if a <= s < b] for a, b in zip(ends, ends[1:], strict=False)]


def test_against_brute_force(monkeypatch):
    values = awkward()
    expected = [slow(t) for t in values]
    assert together(values) == expected and sum(map(len, expected)) > 50
    monkeypatch.setattr(runs, "PAIRS", 7)  # whatever the number of pairs at a time
    assert together(values[:40]) == expected[:40]
    other = [slow(t, 10, 2) for t in values[:40]]
    assert together(values[:40], shortest=10, repeats=2) == other


def test_words_decide_not_hashes():
    class Wrong(runs._Prefixes):
        """Takes words for equal that aren't, more often the longer they are; never the other way round."""

        def equal(self, i, p, length):
            return super().equal(i, p, length) | ((i * 7 + p * 3 + length * 5) % 4 == 0)

    values = awkward()[:60]
    assert together(values, prefixes=Wrong) == [slow(t) for t in values]


def test_time_of_a_text_of_one_word():
    ids = np.zeros(300_000, dtype=np.int64)
    assert runs.find(ids, np.array([0, len(ids)])).tolist() == [[0, 300_000, 1]]


def expected_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *numbers, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(kept))


@pytest.mark.parametrize("own", [False, True])
def test_query_against_brute_force(spark, own, tmp_path):
    folder = "/root/testdata/sf0.001"
    if own:
        folder = f"file://{tmp_path}"
        values = [t for t in texts() if len(t or "") < 20_000] + [" ".join(t) for t in awkward()[:-1]] + ["  \u0085 a\x1c b " * 30]
        schema = "doc_id long, text string, runs string, c0 string, start long, period long, length long, f string, n int, e int, c1 long, `a.b` string"
        spark.createDataFrame(rows_of(values), schema).write.parquet(f"{folder}/documents.parquet")
    found = queries.op12_periodic_runs(spark, folder)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, found.collect())) == sorted(expected_row(*r) for r in docs)


def test_nulls_repeats_and_carried(spark, edge, nothing):
    found = runs.periodic_runs(edge, carry=("n", "text", "source"))
    rows = found.collect()
    assert len(rows) == edge.count() and sum(r.doc_id is None for r in rows) == 2 and {r.c0 for r in rows} == {4}
    assert {(r.n_runs, r.text, r.start) for r in rows if r.doc_id == 0} == {(0, "", None)}
    la = [r for r in rows if r.text == "la"]
    assert len(la) == 1 and [tuple(x) for x in la[0].runs] == [(0, 300, 1)] and la[0].exponent_milli == 300_000
    assert runs.periodic_runs(nothing).count() == 0
