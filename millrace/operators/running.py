"""Running totals of keys of any size: a prefix scan.

The order is cut into slices; totals of each key and slice are summed up over the
slices before, one row each, and added to the running totals inside a slice.
Without keys the whole table is one key and still runs in as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.slices import SLICE_ROWS, slices


def running_totals(
    rows: DataFrame, on: list[str], order: str, totals: dict[str, Column], slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """``rows`` and, by name, the sums of ``totals`` over the rows of the same ``on`` columns whose ``order`` is up to their own.

    As the default frame of SQL: rows of equal order have the same totals, and null
    orders come first.  Null keys are a key.  Nulls add nothing; a total of nulls
    alone is null.  Use whole numbers or decimals where sums must not depend on the
    order of addition.  An empty table gives an empty result.
    """
    columns = [f"c{i}" for i in range(len(rows.columns))]
    named = dict(zip(rows.columns, columns, strict=True))
    values = [f"v{i}" for i in range(len(totals))]
    at = slices(rows, order, slice_rows)
    own = rows.select(*[F.col(f"`{c}`").alias(x) for c, x in named.items()], *[v.alias(x) for v, x in zip(totals.values(), values, strict=True)])
    time, keys = F.col(named[order]), [named[c] for c in on]
    own = own.withColumn("slice", F.coalesce(at(time), F.lit(-1)))
    inside = Window.partitionBy(*keys, "slice").orderBy(time)
    scanned = own.select("*", *[F.sum(v).over(inside).alias(f"{v}_in") for v in values])

    # one row for each key and slice; without keys there is one key
    each = own.groupBy(*keys, "slice").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = each.select(*[F.col(k).alias(f"{k}_key") for k in keys], F.col("slice").alias("its"), *[F.sum(v).over(before).alias(f"{v}_before") for v in values])
    same = F.col("slice") == F.col("its")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_key"))
    found = scanned.join(ahead, same)
    total = lambda v: F.coalesce(F.col(f"{v}_in") + F.col(f"{v}_before"), F.col(f"{v}_in"), F.col(f"{v}_before"))
    return found.select(
        *[F.col(x).alias(c) for c, x in named.items()], *[total(v).alias(name) for v, name in zip(values, totals, strict=True)]
    )
