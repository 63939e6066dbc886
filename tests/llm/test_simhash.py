from __future__ import annotations

import itertools
import random

import xxhash

from millrace.llm import simhash


def slow(text, words=3):
    w = [x for x in (text or "").encode().lower().replace(b"\n", b" ").replace(b"\t", b" ").replace(b"\x0b", b" ").split(b" ") if x]
    shingles = [w[i : i + words] for i in range(len(w) - words + 1)] or ([w] if w else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """Smallest id by fingerprint, links of two bits or fewer, by brute force; ids may be null."""
    nodes = sorted({f for _, f in fps})
    parent = {f: f for f in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f, least.get(find(f))) for i, f in fps), key=str)


def test_matches_brute_force(edge, edge_rows):
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.simhash_components(edge).collect()]
    assert sorted(got, key=str) == components([(r[0], slow(r[1])) for r in edge_rows])


def test_very_long_text():
    rng = random.Random(2)
    text = " ".join(rng.choice("abcdefgh") for _ in range(140_000))  # more shingles than are counted at once, twice
    assert simhash.simhash(text) == slow(text)


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1, 1 << 63]
    fps = {b ^ (1 << i) ^ (1 << j) for b in base for i, j in [(0, 0), (0, 1), (63, 5), (62, 63)]} | {base[0] ^ 7, base[1] ^ 15}
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    from millrace.llm.components import connected_components

    stars = connected_components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    got = {r.node % 2**64: r.component for r in stars}
    expected = {f: c for f, _, c in ((f, 0, c) for i, f, c in components([(f, f) for f in fps]))}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    alone = {f: f for f in fps if f not in got}
    assert groups(got | {f: ("alone", f) for f in alone}) == groups(expected)


def test_long_chain_is_one_component(spark):
    from millrace.llm.components import connected_components

    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(5, 5), (None, 3)], "a long, b long")
    found = connected_components(edges).collect()
    assert {r.component for r in found} == {0} and len(found) == 301


def test_empty(nothing):
    assert simhash.simhash_components(nothing).count() == 0
