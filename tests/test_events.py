"""Joins by time and running totals: against brute force with small slices, and their queries against SQL."""

from __future__ import annotations

import datetime as dt
import functools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import intervals, slices
from millrace.operators.asof import asof_join
from millrace.operators.intervals import interval_join
from millrace.operators.running import running_totals
from millrace.plans import events

DATA = "/root/testdata/sf0.001"
LEFT = "id long, k string, t timestamp, `a.b` string, slice long, l int, r int"
RIGHT = "v long, k string, t timestamp, x string, near int"


def at(second):
    return None if second is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def sides(seed, n=400, span=300):
    """One key holds most rows; times repeat, keys and times are null, rows are repeated, some keys are on one side alone."""
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None, rng.choice("cd")])
    when = lambda: rng.choice([rng.randrange(span), rng.randrange(span) // 50 * 50, None if rng.random() < 0.1 else 7])
    left = [(i, key(), when(), "z", 1, 2, 3) for i in range(n)]
    right = [(rng.randrange(40), key(), when(), rng.choice(["x", None]), 4) for _ in range(n // 2)]
    left += [(1000 + i, "left only", i, "z", 1, 2, 3) for i in range(5)] + left[:7]
    return left, right + [(i, "right only", i, "x", 4) for i in range(5)] + right[:7]


def frames(spark, left, right):
    make = lambda rows, schema: spark.createDataFrame([(*r[:2], at(r[2]), *r[3:]) for r in rows], schema).repartition(3)
    return make(left, LEFT), make(right, RIGHT)


def key_of(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("slice_rows", [1, 10, 100, 1 << 20])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_join(spark, slice_rows, strict):
    left, right = sides(1)
    expected = []
    for row in left:
        seen = [r for r in right if r[1] == row[1] and None not in (row[1], row[2], r[2]) and (r[2] < row[2] or (r[2] == row[2] and not strict))]
        best = max(seen, key=lambda r: (r[2], *key_of(r)), default=(None,) * 5)
        expected.append((*row[:2], at(row[2]), *row[3:], *best[:2], at(best[2]), *best[3:]))
    found = asof_join(*frames(spark, left, right), ["k"], "t", "t", strict=strict, slice_rows=slice_rows)
    assert found.columns == ["id", "k", "t", "a.b", "slice", "l", "r", "right_v", "right_k", "right_t", "right_x", "right_near"]
    assert sorted(map(tuple, found.collect()), key=key_of) == sorted(expected, key=key_of)


def test_asof_join_of_empty_sides(spark):
    left, right = frames(spark, *sides(2, 20))
    assert asof_join(left.where("false"), right, ["k"], "t", "t").count() == 0
    found = asof_join(left, right.where("false"), ["k"], "t", "t").collect()
    assert len(found) == left.count() and {r.right_v for r in found} == {None}
    dates = asof_join(left.withColumn("d", F.to_date("t")), right.withColumn("d", F.to_date("t")), [], "d", "d")
    assert dates.where("d IS NOT NULL AND right_d IS NULL").count() == 0


@pytest.mark.parametrize("slice_rows", [1, 10, 100, 1 << 20])
@pytest.mark.parametrize("keyed", [True, False])
def test_running_totals(spark, slice_rows, keyed):
    rows, _ = sides(3)
    rows = [(*r[:5], r[0] % 5 if r[0] % 7 else None, r[6]) for r in rows]
    table, _ = frames(spark, rows, [])
    found = running_totals(table, ["k"] if keyed else [], "t", {"total": F.col("l") * 10, "n": F.lit(1)}, slice_rows)
    expected = []
    for row in rows:
        up = [r for r in rows if (not keyed or r[1] == row[1]) and (r[2] is None or (row[2] is not None and r[2] <= row[2]))]
        values = [r[5] * 10 for r in up if r[5] is not None]
        expected.append((*row[:2], at(row[2]), *row[3:], sum(values) if values else None, len(up)))
    assert sorted(map(tuple, found.collect()), key=key_of) == sorted(expected, key=key_of)
    assert running_totals(table.where("false"), ["k"], "t", {"n": F.lit(1)}).count() == 0


def test_no_group_has_more_rows_than_its_slice(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.expr("timestamp_seconds(id * id % 10007)").alias("t"))
    of = slices.slices(rows, "t", 500)
    sizes = [r["count"] for r in rows.groupBy(of(F.col("t")).alias("s")).count().collect()]
    assert len(sizes) > 25 and max(sizes) < 1500
    assert rows.where(of(F.col("t")).isNull()).count() == 0
    # slices rise with the order
    ends = rows.groupBy(of(F.col("t")).alias("s")).agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("s").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:], strict=False))


@pytest.mark.parametrize("cell_rows", [1, 9, 1 << 20])
@pytest.mark.parametrize(("before", "after"), [(30, 10), (0, 0), (0, 5), (-2, 7)])
@pytest.mark.parametrize("keyed", [True, False])
def test_interval_join(spark, cell_rows, before, after, keyed):
    left, right = sides(4, 150)
    found = interval_join(*frames(spark, left, right), ["k"] if keyed else [], "t", "t", before, after, cell_rows=cell_rows)
    expected = [
        (*a[:2], at(a[2]), *a[3:], *b[:2], at(b[2]), *b[3:])
        for a in left
        for b in right
        if None not in (a[2], b[2]) and (not keyed or (a[1] == b[1] and a[1])) and a[2] - before <= b[2] <= a[2] + after
    ]
    assert sorted(map(tuple, found.collect()), key=key_of) == sorted(expected, key=key_of) and len(expected) > 20
    assert found.columns[-1] == "right_near"


def test_interval_join_cells_are_even(spark):
    left = spark.range(5).select(F.lit(1).alias("k"), F.expr("timestamp_seconds(id)").alias("t"))
    right = spark.range(10_000).select(F.lit(1).alias("k"), F.expr("timestamp_seconds(id % 3)").alias("t"), "id")
    assert interval_join(left, right, ["k"], "t", "t", 0, 0, cell_rows=100).count() == 10_000
    assert intervals.CELL_ROWS > 1


@pytest.mark.parametrize("own", [False, True])
@pytest.mark.parametrize("name", events.queries())
def test_queries_against_sql(spark, name, own, tmp_path, monkeypatch):
    folder = DATA
    if own:  # ties, and one user with most events
        folder, rng = f"file://{tmp_path}", random.Random(6)
        kinds = ["click", "purchase", "error"]
        rows = [(i, at(i // 7 * 40).replace(tzinfo=None), rng.choice([1, 1, 1, 2, i]), rng.choice(kinds), rng.randrange(99) / 100, "{}") for i in range(600)]
        rows = [r for r in rows if r[3] != "click" or r[0] % 7 == 0]  # no two clicks at a time, so that SQL has one last
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
        for other in ("orders", "lineitem"):
            table = spark.read.parquet(f"{DATA}/{other}.parquet")
            table.union(table.limit(50)).write.parquet(f"{folder}/{other}.parquet")
        monkeypatch.setattr(events, "asof_join", functools.partial(asof_join, slice_rows=50))
        monkeypatch.setattr(events, "running_totals", functools.partial(running_totals, slice_rows=50))
    found = events.queries()[name](spark, folder)
    with duckdb.connect() as db:
        for view in ("events", "orders", "lineitem"):
            path = f"{folder.removeprefix('file://')}/{view}.parquet{'/*.parquet' if own else ''}"
            db.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{path}')")
        told = db.execute(events.oracle_sql()[name])
        names = [c[0] for c in told.description]
        assert sorted(names) == sorted(found.columns)
        expected = told.fetchall()
    assert expected and sorted((tuple(r[c] for c in names) for r in found.collect()), key=key_of) == sorted(expected, key=key_of)

