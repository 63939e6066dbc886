"""Heavy hitters: against counts of everything, whatever the tasks see."""

from __future__ import annotations

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import heavy
from millrace.operators.heavy import heavy_hitters


def test_a_summary_keeps_what_has_more_than_its_share():
    rng = random.Random(1)
    for _ in range(300):
        counters, batches = rng.randrange(1, 6), []
        for _ in range(rng.randrange(1, 8)):
            batches.append([rng.choice("aaabbcdefghijk") if rng.random() < 0.8 else None for _ in range(rng.randrange(12))])
        frames = [pa.RecordBatch.from_arrays([pa.array([x[::2], None, x[1::2]], pa.list_(pa.string()))], names=["v"]) for x in batches]
        kept = [v for out in heavy._summary(counters)(iter(frames)) for v in out.column(0).to_pylist()]
        counts = collections.Counter(v for x in batches for v in x if v is not None)
        assert len(kept) <= counters and len(set(kept)) == len(kept)
        assert {v for v, n in counts.items() if n > sum(counts.values()) / (counters + 1)} <= set(kept)


def test_lowered():
    values, counts = heavy.lowered(pa.array(list("abcd")), np.array([5, 1, 3, 3]), 2)
    assert (values.to_pylist(), counts.tolist()) == (["a"], [2])
    values, counts = heavy.lowered(pa.array(["a"]), np.array([5]), 2)
    assert (values.to_pylist(), counts.tolist()) == (["a"], [5])


@pytest.mark.parametrize("broadcast", [1 << 17, 1])
@pytest.mark.parametrize("share", [0.3, 0.05, 0.01])
def test_against_all_counts(spark, monkeypatch, share, broadcast):
    monkeypatch.setattr(heavy, "BROADCAST_ROWS", broadcast)
    rng = random.Random(2)
    rows = [(i, None if i % 50 == 0 else [rng.choice(["hot", "hot", "warm", str(rng.randrange(9)), str(rng.randrange(900)), None]) for _ in range(rng.randrange(8))]) for i in range(1500)]
    # sorted by value in part, so that tasks see very different rows; value and n are names of ours
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "id long, v array<string>, value string, n int").repartitionByRange(7, "v")
    counts = collections.Counter(x for _, v in rows for x in v or [] if x is not None)
    total = sum(counts.values())
    expected = sorted((v, n, total) for v, n in counts.items() if n > share * total)
    assert expected and sorted(map(tuple, heavy_hitters(table, F.col("v"), share).collect())) == expected


def test_numbers_empty_and_bounds(spark):
    numbers = spark.range(1000).select(F.when(F.col("id") % 4 > 0, F.col("id") % 3).alias("x"))
    assert sorted(map(tuple, heavy_hitters(numbers, F.array("x"), 0.32).collect())) == [(0, 250, 750), (1, 250, 750), (2, 250, 750)]
    assert heavy_hitters(numbers, F.array("x"), 0.4).count() == 0
    assert heavy_hitters(numbers.where("false"), F.array("x"), 0.1).count() == 0
    with pytest.raises(ValueError, match="share"):
        heavy_hitters(numbers, F.array("x"), 1.0)
