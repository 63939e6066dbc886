"""Best-fit packing of token sequences, by best-two-fit over the lengths of all documents.

Only lengths matter to the packing, and there are at most as many as a sequence
holds tokens.  So the numbers of pieces by length are counted over all
documents, the packing is planned on the driver from this short list, and the
pieces of each length are dealt to the plan's places by their rank.  The plan
and the work on the driver have a bounded size, whatever the input's.

A bin is filled greedily, longest fitting piece first; then its smallest piece
is replaced by two unpacked ones if they fill the gap that it leaves more
tightly.  A filled bin's pattern is repeated as often as the counts allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.scratch import materialize, named, session, tidied
from millrace.llm.tokens import encoder

CAPACITY = 2048
END = 0
#: Numbers of pieces by task and length that are broadcast to the pieces, at most; more are joined by shuffle.
BROADCAST_ROWS = 1 << 20


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Pieces by length -> (the lengths in a bin, how many such bins), for all pieces."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths, bins = np.arange(capacity + 1), []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return bins
        # below[x]: the longest piece left of length x at most
        below = np.maximum.accumulate(np.where(left > 0, lengths, 0))
        pattern, gap = [], capacity
        used: dict[int, int] = {}
        while gap:
            x = int(below[gap])
            while x and left[x] <= used.get(x, 0):
                x = int(below[x - 1])
            if not x:
                break
            pattern.append(x)
            used[x] = used.get(x, 0) + 1
            gap -= x
        if gap and len(pattern) > 1:
            _two_for_smallest(left, below, pattern, used, gap)
        times = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
        bins.append((pattern, times))


def _two_for_smallest(left: np.ndarray, below: np.ndarray, pattern: list[int], used: dict[int, int], gap: int) -> None:
    smallest = pattern[-1]
    free = left.copy()
    for x, n in used.items():
        free[x] -= n
    room = gap + smallest
    if len(free) <= room:
        room = len(free) - 1
    lengths = np.arange(len(free))
    under = np.maximum.accumulate(np.where(free > 0, lengths, 0))
    one = lengths[1:room][free[1:room] > 0]
    if not len(one):
        return
    two = under[room - one]
    same = (two == one) & (free[one] < 2)  # the same piece can't be taken twice
    two = np.where(same, under[one - 1], two)
    total = np.where(two > 0, one + two, 0)
    best = int(total.argmax())
    if total[best] > smallest:
        pattern.pop()
        used[smallest] -= 1
        if not used[smallest]:
            del used[smallest]
        for x in sorted((int(one[best]), int(two[best])), reverse=True):
            pattern.append(x)
            used[x] = used.get(x, 0) + 1


def slots(bins: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank: where the pieces of a length go."""
    rows, given, sequence = [], {}, 0
    for pattern, times in bins:
        offset = 0
        for length in pattern:
            rows.append((length, given.get(length, 0), sequence, offset))
            given[length] = given.get(length, 0) + times
            offset += length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """(id, text) -> (doc_id, piece, start, length, ids, part, nth): a document's ids and ``end``, cut if too long.

    Only documents of more than ``capacity`` ids are cut, into pieces of just that
    many, the first of which may be shorter.  ids are little-endian unsigned 32-bit
    numbers.  A null text counts as empty and gives a piece of ``end`` alone; repeated
    rows are documents of their own; other columns are ignored; an empty table gives
    none.  A very long text is encoded whole by one task.
    Within the task ``part``, the piece is the ``nth`` of its length.
    """
    session(docs)
    schema = "doc_id long, piece int, start long, length long, ids binary, part int, nth long"
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64).tolist()
        names = schema.replace(",", "").split()[::2]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
        for batch in batches:
            rows, held = [], 0
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(_texts(batch.column(1))), strict=True):
                ids += tail
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, k, i, j - i, ids[4 * i : 4 * j], part, seen[j - i]))
                    seen[j - i] += 1
                held += n
                if held > 1 << 21:
                    yield _batch(rows, kinds, names)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, kinds, names)

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return rows.mapInArrow(tidied(run, encodes=True), schema)


def _texts(column: pa.Array) -> Iterator[str | None]:
    return (t.as_py() for t in column)


def _batch(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
    )


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with length, part and nth (and any other columns) -> the same with sequence_id and offset for these two.

    Every piece gets a place in a sequence of ``capacity`` tokens, gapless from 0.
    Pieces of one length are alike to the packing and go by part and nth.  The
    pieces are written once, as task numbers hold for one run only.
    """
    table = materialize(cut, "pieces")
    counts = materialize(table.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = table.sparkSession.sparkContext.broadcast(slots(plan(totals, capacity)))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts.hint("merge")
    ranked = table.join(counts, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("ahead"))
    ranked = ranked.select(*[c for c in table.columns if c != "part"])
    schema = T.StructType(
        [f for f in ranked.schema if f.name != "nth"]
        + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = where.value
        wide = int(rows[:, 1].max(initial=0)) + 1
        keys = rows[:, 0] * wide + rows[:, 1]
        for batch in batches:
            length, nth = (batch.column(c).to_numpy() for c in ("length", "nth"))
            at = np.searchsorted(keys, length * wide + np.minimum(nth, wide - 1), "right") - 1
            sequence = rows[at, 2] + nth - rows[at, 1]
            own = [batch.column(f.name) for f in schema[:-2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(rows[at, 3])], names=schema.names)

    return ranked.mapInArrow(tidied(run), schema)


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """(id, text) -> (doc_id, piece, start, length, ids, sequence_id, offset): every token of every document, placed.

    Null, repeated and empty as for ``pieces``.
    """
    return place(pieces(docs, tokenizer, id_col, text_col, capacity, end), capacity)
