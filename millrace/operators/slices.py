"""Slices of an order, so that no task needs all rows of a key.

A window over a key puts all of its rows into one task, and a key may hold a
third of all rows.  Cut into slices of the order's values with about equally many
rows, a key is as many groups as it has slices, and none of them has more rows
than its slice.  What a group needs from the ones before it is one row each.

The cuts come from a sample, as those of a range partitioning do; they decide
where rows are worked on, never what comes out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a slice, about, the most slices, and rows of the sample for each.
SLICE_ROWS, MOST, SAMPLED = 1 << 20, 1 << 16, 20


def micros(value: Column, kind: str) -> Column:
    """Microseconds of a timestamp; of one without time zone those of its own clock, whatever the session's zone."""
    if kind != "timestamp_ntz":
        return F.unix_micros(value.cast("timestamp"))
    seconds = F.unix_date(value.cast("date")).cast("long") * 86_400 + F.hour(value) * 3600 + F.minute(value) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), value) * 1_000_000).cast("long")


def order_number(value: Column, kind: str) -> Column:
    """A whole number that rises with the value, of a number, a date or a timestamp; equal values have the same."""
    if kind.startswith("timestamp"):
        return micros(value, kind)
    if kind == "date":
        return F.unix_date(value).cast("long")
    return F.floor(value.cast("double")).cast("long")


def slices(rows: DataFrame, order: str, slice_rows: int = SLICE_ROWS) -> Callable[[Column], Column]:
    """The slice, from 0, of a value of the column ``order``, by cuts that leave each about ``slice_rows`` of the rows.

    Reads the column twice; at most SAMPLED * MOST of its values reach the driver,
    whatever the number of rows.  Null values have no slice; equal values share one.
    """
    kind = dict(rows.dtypes)[order]
    values = rows.select(order_number(F.col(order), kind).alias("x")).where("x IS NOT NULL")
    n = values.count()
    many = min(MOST, -(-n // slice_rows))
    if many < 2:
        return lambda value: F.when(value.isNotNull(), F.lit(0))
    drawn = sorted(r[0] for r in values.sample(min(1.0, SAMPLED * many / n), seed=7).collect())
    cuts = sorted({drawn[len(drawn) * i // many] for i in range(1, many)}) if drawn else []
    if not cuts:
        return lambda value: F.when(value.isNotNull(), F.lit(0))
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

    def of(value: Column) -> Column:
        x = order_number(value, kind)
        # the number of cuts up to the value, by binary search
        step = lambda at, k: F.when(F.get(bounds, at + k - 1) <= x, at + k).otherwise(at)
        return F.when(x.isNotNull(), F.aggregate(steps, F.lit(0), step))

    return of
