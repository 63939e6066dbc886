"""Heavy hitters: all values that make up more than a share of the rows, with exact counts, without shuffling the others.

A first pass keeps a bounded summary of each task's rows: no more counters than
1 / share, of which each is lowered whenever another would be needed (the summary of
Misra and Gries).  A value with more than the share of all rows has more than the
share of some task's rows, and then keeps a counter there; so the counters of all
tasks name every heavy value, and at most 1 / share others a task.  A second pass
counts these exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidates that are broadcast to the second pass, at most; more are joined by shuffle.
BROADCAST_ROWS = 1 << 17


def lowered(values: pa.Array, counts: np.ndarray, counters: int) -> tuple[pa.Array, np.ndarray]:
    """Of distinct values with their counts, those whose counts are left when ``counters`` of them are enough.

    All counts are lowered by that which comes next after the ``counters`` largest: each
    time one is lowered, ``counters`` others are too.
    """
    if len(counts) <= counters:
        return values, counts
    counts = counts - np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1]
    left = np.flatnonzero(counts > 0)
    return values.take(pa.array(left)), counts[left]


def _summary(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = None, np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(0).flatten().drop_null()
            new = pa.table({"value": column, "n": pa.array(np.ones(len(column), np.int64))})
            if values is not None:
                new = pa.concat_tables([pa.table({"value": values, "n": pa.array(counts)}), new])
            found = new.group_by("value").aggregate([("n", "sum")]).combine_chunks()
            values, counts = lowered(found.column("value").combine_chunks(), found.column("n_sum").to_numpy(), counters)
        if values is not None and len(values):
            yield pa.RecordBatch.from_arrays([values], names=["value"])

    return run


def heavy_hitters(rows: DataFrame, values: Column, share: float) -> DataFrame:
    """(value, n, total): every value that makes up more than ``share`` of all, how often it is there, and how many all are.

    ``values`` is an array, the values of a row; for a single one, an array of it.  Null arrays and values count
    for nothing.  ``rows`` is read three times: it should be a table or cheap to make again.  Each
    value is counted exactly, so no tie is cut; an empty table gives an empty result.
    Values may be of any type that can be grouped by.
    """
    if not 0 < share < 1:
        raise ValueError(f"share must lie between 0 and 1, not {share}")
    arrays = rows.select(values.alias("values")).where("values IS NOT NULL")
    kind = arrays.schema["values"].dataType.elementType.simpleString()
    # one more counter than values can be heavy, so rounding doesn't matter
    candidates = arrays.mapInArrow(_summary(int(1 / share) + 1), f"value {kind}").distinct()
    known = candidates.limit(BROADCAST_ROWS + 1).collect()
    if len(known) <= BROADCAST_ROWS:
        candidates = F.broadcast(rows.sparkSession.createDataFrame(known, candidates.schema))
    total = arrays.agg(F.sum(F.size(F.array_compact("values")))).first()[0] or 0
    each = arrays.select(F.explode("values").alias("value"))
    counts = each.join(candidates, "value", "left_semi").groupBy("value").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > F.lit(share) * F.lit(total)).select("value", "n", F.lit(total).cast("long").alias("total"))
