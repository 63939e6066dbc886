"""Interval join: pairs of rows of equal keys whose times lie within an interval of each other.

Time is cut into bins as long as the interval, so a row's interval touches two
bins at most.  A right row is in the bin of its time alone, a left row in each bin
that its interval touches, and no pair can meet twice.  A bin of a key with many
right rows is dealt into cells, to all of which its left rows go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.slices import micros

#: Right rows in a cell, about.
CELL_ROWS = 1 << 17


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_time: str,
    right_time: str,
    before: int,
    after: int,
    prefix: str = "right_",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Pairs of a row of ``left`` and one of ``right`` with equal ``on`` and a right time from ``before`` to ``after`` seconds around the left one.

    Both ends are included: left time - before <= right time <= left time + after.
    Times are timestamps, both of one kind.  Right columns are named ``prefix`` and their
    name.  Null keys and times are in no pair; repeated rows pair each for itself; an
    empty side gives an empty result.
    """
    keys = [f"k{i}" for i in range(len(on))]
    low, high = before * 1_000_000, after * 1_000_000
    width = max(low + high, 1)

    def side(rows: DataFrame, time: str, name: str) -> DataFrame:
        columns = [F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)]
        whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)])
        out = rows.select(*columns, micros(F.col(f"`{time}`"), dict(rows.dtypes)[time]).alias(f"{name}_t"), whole.alias(name))
        return out.dropna(subset=[*keys, f"{name}_t"])

    bin_of = lambda t: F.expr(f"({t} - pmod({t}, {width}L)) div {width}L")  # noqa: E731  in whole numbers, rounded down
    others = side(right, right_time, "r").withColumn("bin", bin_of("r_t"))
    own = side(left, left_time, "l")
    own = own.withColumns({"lo": F.col("l_t") - low, "hi": F.col("l_t") + high})
    own = own.withColumn("bin", F.explode(F.sequence(bin_of("lo"), bin_of("hi"))))
    # only bins of many rows are dealt, so there is one row here for each cell_rows rows of the table at most
    many = others.groupBy(*keys, "bin").count().where(F.col("count") > cell_rows)
    cells = many.select(*keys, "bin", F.ceil(F.col("count") / cell_rows).cast("int").alias("cells"))
    dealt = others.join(cells, [*keys, "bin"], "left").withColumn("cell", F.pmod(F.xxhash64("r"), F.coalesce("cells", F.lit(1))).cast("int"))
    met = own.join(cells, [*keys, "bin"], "left")
    met = met.withColumn("cell", F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1)))
    pairs = met.drop("cells").join(dealt.drop("cells"), [*keys, "bin", "cell"]).where("r_t BETWEEN lo AND hi")
    return pairs.select(
        *[F.col(f"l.c{i}").alias(c) for i, c in enumerate(left.columns)],
        *[F.col(f"r.c{i}").alias(f"{prefix}{c}") for i, c in enumerate(right.columns)],
    )
