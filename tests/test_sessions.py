"""Sessions of a stream: in batches, out of order, late, and after a restart."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.streaming import sessions

SCHEMA = "k string, t timestamp, v double, first long"
GAP, LATE = 10, 30


def test_merged():
    spans = [[5, 5, 1, 2], [0, 0, 1, 1], [16, 16, 1, 1], [15, 15, 1, 1], [40, 44, 2, 3], [27, 27, 1, 0]]
    assert sessions.merged(spans, 10) == [[0, 16, 4, 5], [27, 27, 1, 0], [40, 44, 2, 3]]
    assert sessions.merged([], 10) == []


@pytest.fixture
def stream(spark, tmp_path):
    """Writes a batch of (key, second, value), runs what is there, and gives all closed sessions and the late rows so far."""
    source, late = f"{tmp_path}/in", [0]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.STATE_STORE)

    def run(*batches):
        for rows in batches:
            table = spark.createDataFrame([(k, s, v, 0) for k, s, v in rows], "k string, s long, v double, first long")
            table.select("k", F.timestamp_seconds("s").alias("t"), "v", "first").coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        found = sessions.sessions(events, "k", "t", "v", GAP, LATE)
        query = found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        query = query.start(f"{tmp_path}/out")
        query.awaitTermination()
        late[0] += sessions.late_rows(query)
        rows = spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect()
        return sorted((r.key, r.first // 10**6, r.last // 10**6, r.n, r.total) for r in rows), late[0]

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_batches_late_rows_and_a_restart(stream):
    # out of order and across batches, at a distance of just the gap and of one more
    found, late = stream([("a", 100, 1.0), ("a", 110, 2.0), ("b", 100, None), (None, 5, 1.0)], [("a", 121, 4.0), ("a", 95, 8.0), ("b", 100, 1.0)])
    assert (found, late) == ([], 0)  # the watermark is at 91
    # after a restart the state is there: the watermark goes to 170, and closes all up to there
    found, late = stream([("c", 200, 1.0)])
    assert (found, late) == ([("a", 95, 110, 3, 11), ("a", 121, 121, 1, 4), ("b", 100, 100, 2, 1)], 0)
    # one row is late; one is older than the greatest time, but not late
    found, late = stream([("a", 120, 1.0), ("c", 191, 2.0), ("d", 300, 0.0)], [("d", 301, 0.0)])
    assert late == 1 and ("c", 191, 200, 2, 3) in found and len(found) == 4


def test_equal_to_the_sessions_of_all_rows(stream):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", f"k{rng.randrange(5)}"]), 1000 + i // 2 + rng.randrange(20), float(rng.randrange(9))) for i in range(900)]
    rows = [r for r in rows if r[1] % 37 > 12]
    found, late = stream(rows[:300], rows[300:600], rows[600:], [("end", 5000, 0.0)])
    expected = []
    for key in {k for k, *_ in rows}:
        own = [[s, s, 1, int(v)] for k, s, v in rows if k == key]
        expected += [(key, *s) for s in sessions.merged(own, GAP)]
    assert (found, late) == (sorted(expected), 0) and len(found) > 60


def test_all_open_sessions_of_a_key_are_one_value_of_state():
    calls = []

    class Value:
        kept = None

        def get(self):
            calls.append("get")
            return self.kept

        def update(self, value):
            calls.append("update")
            self.kept = value

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return Value()

        def registerTimer(self, at):  # noqa: N802
            calls.append(at)

    processor, hours = sessions.Sessions(GAP * 10**6), 3600 * 10**6
    processor.init(Handle())
    frame = pd.DataFrame({"first": [i * hours for i in range(500)], "last": [i * hours + 1 for i in range(500)], "n": 1, "total": range(500)})
    assert list(processor.handleInputRows(("a",), iter([frame[250:], frame[:250]]), None)) == []
    assert calls == ["get", "update", GAP * 1000 + 1]
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 400 * hours // 1000)
    (closed,) = processor.handleExpiredTimer(("a",), now, None)
    assert closed.columns.tolist() == ["key", "first", "last", "n", "total"] and closed.key.tolist() == ["a"] * 400
    assert closed.total.tolist() == list(range(400)) and len(calls) == 6
