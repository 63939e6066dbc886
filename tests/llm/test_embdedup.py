from __future__ import annotations

import math

import numpy as np

from millrace.llm import embdedup

SCHEMA = "vec_id long, embedding array<float>, label int, gid long, cell long, vec string, home int, copies int"


def slow(rows, threshold):
    ok, ids = [], [r[0] for r in rows]
    for k, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.append(k)
    unit = {k: (x := np.array(rows[k][1], dtype=np.float64)) / np.linalg.norm(x) for k in ok}
    near = {k: [j for j in ok if j != k and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= threshold] for k in ok}
    out, seen = {}, {}
    for k in range(len(rows)):
        if k in seen:
            continue
        group, front = {k}, [k]
        while front:
            for j in near.get(front.pop(), []):
                if j not in group:
                    group.add(j)
                    front.append(j)
        for j in group:
            seen[j] = min((ids[i] for i in group if ids[i] is not None), default=None)
    for k in range(len(rows)):
        out.setdefault(ids[k], []).append((len(near.get(k, [])), seen[k]))
    return {i: sorted(x, key=str) for i, x in out.items()}


def data(n=400, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        c = centres[rng.integers(6)] + rng.normal(size=dim) * rng.choice([0.05, 0.25, 1.0])
        rows.append((i, [float(np.float32(x)) for x in c], int(rng.integers(3))))
    hot = rows[0][1]
    rows += [(n + i, hot, rows[0][2]) for i in range(150)]
    rows += [(n + 200 + i, [x * 3 for x in hot], rows[0][2]) for i in range(2)]
    rows += [(2000, None, 1), (2001, [0.0] * dim, 1), (2002, [float("nan")] * dim, 1), (2003, [float("inf")] + hot[1:], 1)]
    rows += [(2004, hot, None), (2005, hot[:5], 0), (2006, hot[:5], 0), (2007, [], 0), (2008, [None, *hot[1:]], 0)]
    rows += [rows[5], rows[5], (None, rows[7][1], rows[7][2])]
    return rows


def check(spark, rows, threshold=0.93):
    docs = spark.createDataFrame([(*r, 1, 2, "v", 3, 4) for r in rows], SCHEMA).repartition(3)
    found = embdedup.embedding_links(docs, threshold=threshold).collect()
    got = {}
    for r in found:
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
        assert r.kept == (r.component_id is None or r.vec_id == r.component_id)
    assert {i: sorted(x, key=str) for i, x in got.items()} == slow(rows, threshold)


def test_matches_brute_force(spark):
    check(spark, data())


def test_many_cells_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "CELL", 4)
    monkeypatch.setattr(embdedup, "CELLS", 5)  # several levels
    monkeypatch.setattr(embdedup, "BLOCK", 20)
    monkeypatch.setattr(embdedup, "PROBES", 30)
    monkeypatch.setattr(embdedup, "worthwhile", lambda x, cut, *_: (cut, 300.0))
    check(spark, data(seed=3))
    check(spark, data(seed=4), threshold=0.7)


def test_empty(spark):
    assert embdedup.embedding_links(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(1, None, 1), (2, [0.0], 1)])


def test_two_rows_within_reach_meet_once():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) + 3 * rng.normal(size=(5, 6))[rng.integers(0, 5, 300)]
    x = embdedup.unit(x)
    cut = embdedup.levels(x, 60)
    assert len(cut) > 1
    row, cell, guest = embdedup.places(x, cut, 0.374)
    where: dict[int, dict[int, int]] = {}
    for r, c, g in zip(row.tolist(), cell.tolist(), guest.tolist(), strict=True):
        where.setdefault(r, {})[c] = g
    assert (np.unique(row[guest == 0], return_counts=True)[1] == 1).all()
    near = np.argwhere(np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)) <= 0.374)
    assert len(near) > 1000
    for i, j in near.tolist():
        met = [c for c in where[i] if c in where[j] and not where[i][c] & where[j][c]]
        assert i == j or len(met) == 1


def test_levels_end_where_copies_cost_more_than_they_save():
    rng = np.random.default_rng(6)
    reach = float(np.sqrt(2 - 2 * 0.93))
    plain = embdedup.unit(rng.normal(size=(10_000, 64)))
    cut, copies = embdedup.worthwhile(plain, embdedup.levels(plain, 1 << 16), 1 << 20, reach)
    assert len(cut) == 1 and copies < 256
    # not even one level for few rows
    assert embdedup.worthwhile(plain, embdedup.levels(plain, 8), 2000, reach) == ([], 1.0)
    grouped = embdedup.unit(rng.normal(size=(200, 64))[rng.integers(0, 200, 10_000)] + 0.02 * rng.normal(size=(10_000, 64)))
    cut, copies = embdedup.worthwhile(grouped, embdedup.levels(grouped, 200), 1 << 20, reach)
    assert len(cut) == 1 and copies < 3
    assert embdedup.worthwhile(plain, [], 100, reach) == ([], 1.0)
