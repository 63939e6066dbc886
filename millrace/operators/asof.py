"""As-of join: with each row of one side the last row of the other, of the same key, up to its time.

Both sides are united and put in order once; the last row of the right side is
carried down.  The order is cut into slices (``slices``), so a hot key is many
groups; into each of them the last row of the slices before is carried, one row
for each key and slice.  No row meets another but the one it is joined with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.slices import SLICE_ROWS, slices


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_time: str,
    right_time: str,
    prefix: str = "right_",
    strict: bool = False,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Every row of ``left`` with the columns of the last row of ``right`` before it, named ``prefix`` and their name.

    The last row is that of equal ``on`` columns with the greatest ``right_time`` up
    to ``left_time``, before it with ``strict``; of equal times, that whose columns
    are greatest, compared in their order (so they must be of types that have one).  Columns of
    ``right`` are null where there is no such row: for null keys and times too.
    Repeated left rows stay, an empty side is an empty side.  The columns that
    ``prefix`` gives may be named like those of ``left``; then both are there.
    """
    keys = [f"k{i}" for i in range(len(on))]
    key_of = lambda rows: [F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)]
    whole = lambda rows: F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)])
    own = left.select(*key_of(left), F.col(f"`{left_time}`").alias("t"), whole(left).alias("l"))
    other = right.select(*key_of(right), F.col(f"`{right_time}`").alias("t"), whole(right).alias("r"))
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*keys, "t"])
    other, kind = other.where(known), other.schema["r"].dataType
    # keys without a right row would only be carried past each other
    at = slices(own.select("t").union(other.select("t")), "t", slice_rows)
    none = F.lit(None)
    # of equal times, what the left row may see is before it
    both = own.where(known).select(*keys, "t", "l", none.cast(kind).alias("r"), F.lit(0 if strict else 1).alias("side"))
    both = both.union(other.select(*keys, "t", none.cast(own.schema["l"].dataType), "r", F.lit(1 if strict else 0)))
    both = both.withColumn("slice", at(F.col("t")))
    order = Window.partitionBy(*keys, "slice").orderBy("t", "side", "r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("near", F.last("r", ignorenulls=True).over(order)).where("l IS NOT NULL")

    # the last right row of each key and slice, and of the slices before each
    last = other.withColumn("slice", at(F.col("t"))).groupBy(*keys, "slice").agg(F.max(F.struct("t", "r")).alias("x"))
    ends = last.select(*keys, "slice", F.col("x.r").alias("r"), F.lit(False).alias("asks"))
    asked = own.where(known).select(*keys, at(F.col("t")).alias("slice")).distinct()
    ends = ends.union(asked.select(*keys, "slice", none.cast(kind), F.lit(True)))
    before = Window.partitionBy(*keys).orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("far", F.last("r", ignorenulls=True).over(before)).where("asks").select(*keys, "slice", "far")
    joined = met.join(carried, [*keys, "slice"], "left").select("l", F.coalesce("near", "far").alias("r"))
    joined = joined.union(own.where(f"NOT ({known})").select("l", none.cast(kind)))
    return joined.select(
        *[F.col(f"l.c{i}").alias(c) for i, c in enumerate(left.columns)],
        *[F.col(f"r.c{i}").alias(f"{prefix}{c}") for i, c in enumerate(right.columns)],
    )
