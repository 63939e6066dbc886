"""Blocks of whole documents, and the exchange that tells blocks which of their keys occur elsewhere.

A block is a run of whole documents of one input split, compressed into one
row of a table in the shared folder.  Operators that must compare windows of
all documents hash them block by block; a block sends each distinct key once,
sorted and packed by key range, and gets one bit back for each: whether the key
occurs anywhere else.  Positions never travel: a later pass hashes the block
again and applies the bits in order.  A key that a third of all rows hold
therefore reaches its range once for each block, and no group of rows is ever
gathered in a task beyond one key range, whose share shrinks with the number of
shuffle partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.scratch import materialize, named, shuffle_partitions, tidied

BLOCK_BYTES = 6 << 20
#: Of a stored table, as much for each range of keys at most: the keys of a range are in memory, at about a third of this.
RANGE_BYTES = 512 << 20
#: The level of the rows that hold the block itself: sorted after all answers.
LAST = 127
ASKS = "bucket int, block long, keys binary, checks binary, multi binary"
ANSWERS = "block long, level int, bucket int, n int, payload binary"


def pack(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def unpack_both(payload: bytes) -> tuple[pa.Table, pa.Table]:
    """Two tables packed one behind the other."""
    reader = pa.BufferReader(payload)
    return tuple(pa.ipc.open_stream(reader).read_all().combine_chunks() for _ in range(2))


def slices(batches: Iterator[pa.RecordBatch], size: int, text_at: int) -> Iterator[pa.Table]:
    """Tables of whole rows that hold about ``size`` bytes of text each, or one longer text."""
    hold, held = [], 0
    for batch in batches:
        lengths = batch.column(text_at).cast(pa.large_binary())
        lengths = pa.compute.fill_null(pa.compute.binary_length(lengths), 0).to_numpy()
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + (not held), int(np.searchsorted(ends, before + size - held, "right")))
            if upto > at:
                hold.append(batch.slice(at, upto - at))
                held += int(ends[upto - 1] - before)
            if upto < batch.num_rows or held >= size:
                yield pa.Table.from_batches(hold)
                hold, held = [], 0
            at = upto
    if hold:
        yield pa.Table.from_batches(hold)


def block_ids() -> Iterator[int]:
    """Numbers that no other task gives; they are fixed once the table that holds them is written."""
    first = TaskContext.get().partitionId() << 32
    return iter(range(first, first + (1 << 32)))


def carried(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """doc_id, text and the carried columns as c0, c1 and so on, whatever their names are; text isn't carried twice."""
    extra = [named(c).alias(f"c{i}") for i, c in enumerate(carry) if c != text_col]
    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"), *extra)


def carried_fields(docs: DataFrame, carry: tuple[str, ...]) -> list[T.StructField]:
    return [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]


def carried_column(i: int, carry: tuple[str, ...], text_col: str) -> str:
    """The name under which ``carried`` has the i-th carried column."""
    return "text" if carry[i] == text_col else f"c{i}"


def write_blocks(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    carry: tuple[str, ...] = (),
    size: int = BLOCK_BYTES,
    also: Callable[[pa.Table], pa.Table] | None = None,
) -> DataFrame:
    """(block, payload): whole documents in blocks, in each by id (nulls last), then text; behind them what ``also`` makes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = block_ids()
        for table in slices(batches, size, 1):
            table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
            payload = pack(table) + (pack(also(table)) if also else b"")
            columns = [pa.array([next(ids)]), pa.array([payload], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "payload"])

    rows = carried(docs, id_col, text_col, carry).mapInArrow(tidied(run), "block long, payload binary")
    return materialize(rows, "blocks", "none")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with one key, from rows sorted by it."""
    now, rows = None, []
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        for i in range(batch.num_rows):  # row by row, so that no more than one run is copied out of the batch
            row = {name: column[i].as_py() for name, column in columns.items()}
            if row[key] != now and rows:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def by_block(
    blocks: DataFrame, answers: DataFrame | None, run: Callable[[int, bytes, list[list[dict]]], Iterator], schema
) -> DataFrame:
    """Call run(block, payload, answers by level) for each block; it gives record batches of ``schema``."""
    if answers is None:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, payload in zip(*batch.columns, strict=True):
                    yield from run(block.as_py(), payload.as_py(), [])

        return blocks.mapInArrow(tidied(alone), schema)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in groups(batches, "block"):
            *given, own = rows
            if own["level"] != LAST:  # a block that was not written has no rows to answer
                raise RuntimeError(f"block {block} is missing")
            levels: list[list[dict]] = []
            for row in given:
                levels.extend([] for _ in range(row["level"] + 1 - len(levels)))
                levels[row["level"]].append(row)
            yield from run(block, own["payload"], levels)

    own = blocks.select("block", F.lit(LAST).alias("level"), F.lit(0).alias("bucket"), F.lit(0).alias("n"), "payload")
    rows = answers.select("block", "level", "bucket", "n", "payload").union(own)
    rows = rows.repartition(ranges(blocks), "block")
    return rows.sortWithinPartitions("block", "level", "bucket").mapInArrow(tidied(met), schema)


def bits(rows: list[dict], n: int) -> np.ndarray:
    """The answers of one level to the n keys that a block has asked about."""
    if not rows:
        return np.zeros(n, dtype=bool)
    out = np.concatenate([np.unpackbits(np.frombuffer(r["payload"], np.uint8), count=r["n"]) for r in rows])
    if len(out) != n:
        raise RuntimeError(f"{len(out)} answers to {n} keys")
    return out.astype(bool)


def heavy_bits(rows: list[dict], n: int) -> np.ndarray:
    """Of the same, the bits of keys with many occurrences."""
    if not rows:
        return np.zeros(n, dtype=bool)
    parts = [np.frombuffer(r["payload"], np.uint8)[-(-r["n"] // 8) :] for r in rows]
    parts = [np.unpackbits(x, count=r["n"]) if len(x) else np.zeros(r["n"], np.uint8) for x, r in zip(parts, rows, strict=True)]
    return np.concatenate(parts).astype(bool)


def edges_of(buckets: int) -> np.ndarray:
    """The first key of each bucket but the first."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)


def ask(
    block: int, keys: np.ndarray, checks: np.ndarray | None, multi: np.ndarray, buckets: int, copies: np.ndarray | None = None
) -> Iterator[pa.RecordBatch]:
    """Sorted distinct keys of a block, with more bits of each or none, whether the block has it twice, and how often."""
    often = None if copies is None else np.minimum(copies, 0xFFFF).astype("<u2")
    cuts = [0, *np.searchsorted(keys, edges_of(buckets)).tolist(), len(keys)]
    rows = [
        (
            b,
            block,
            keys[i:j].tobytes(),
            b"" if checks is None else checks[i:j].tobytes(),
            np.packbits(multi[i:j]).tobytes() + (b"" if often is None else often[i:j].tobytes()),
        )
        for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))
        if j > i
    ]
    if rows:
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "keys", "checks", "multi"])


def ranges(stored: DataFrame) -> int:
    """Ranges of keys for a stored table: the shuffle partitions, or as many more as keep each within memory."""
    size = int(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(shuffle_partitions(stored.sparkSession), -(-size // RANGE_BYTES))


def repeated(asks: DataFrame, level: int, buckets: int, differing: bool = False, heavy: int = 0) -> DataFrame:
    """Answers to ``asks``: for each key, whether it occurs elsewhere (in another block, or twice in its own).

    Keys with checks are equal if these are equal too; with ``differing``, only
    occurrences with another check count.  With ``heavy``, bits follow of the keys
    that have more than so many occurrences in all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in groups(batches, "bucket"):
            parts = [np.frombuffer(r["keys"], np.uint64) for r in rows]
            keys = np.concatenate(parts)
            found = np.concatenate(
                [np.unpackbits(np.frombuffer(r["multi"], np.uint8), count=len(p)) for r, p in zip(rows, parts, strict=True)]
            ).astype(bool)
            many, often = np.zeros(len(keys), dtype=bool), None
            if heavy:
                often = np.concatenate([np.frombuffer(r["multi"], "<u2", offset=-(-len(p) // 8)) for r, p in zip(rows, parts, strict=True)])
            if rows[0]["checks"]:
                kind = f"<u{len(rows[0]['checks']) // len(parts[0])}"
                checks = np.concatenate([np.frombuffer(r["checks"], kind) for r in rows])
                order = np.lexsort((checks, keys))
                same = keys[order[1:]] == keys[order[:-1]]
                if often is not None:
                    _many(same, often[order], many, order, heavy)
                if differing:
                    _shared(keys[order], checks[order], found, order)
                    same[:] = False
                else:
                    same &= checks[order[1:]] == checks[order[:-1]]
            else:
                order = np.argsort(keys, kind="stable")
                same = keys[order[1:]] == keys[order[:-1]]
                if often is not None:
                    _many(same, often[order], many, order, heavy)
            found[order[1:][same]] = True
            found[order[:-1][same]] = True
            ends = np.cumsum([len(p) for p in parts]).tolist()
            cuts = list(zip([0, *ends], ends, strict=False))
            out = [np.packbits(found[i:j]).tobytes() for i, j in cuts]
            if many.any():
                out = [x + np.packbits(many[i:j]).tobytes() if many[i:j].any() else x for x, (i, j) in zip(out, cuts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["block"] for r in rows]),
                    pa.array([level] * len(rows), pa.int32()),
                    pa.array([bucket] * len(rows), pa.int32()),
                    pa.array([len(p) for p in parts], pa.int32()),
                    pa.array(out, pa.binary()),
                ],
                names=["block", "level", "bucket", "n", "payload"],
            )

    return asks.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(tidied(run), ANSWERS)


def _many(same: np.ndarray, often: np.ndarray, many: np.ndarray, order: np.ndarray, heavy: int) -> None:
    """Mark all of a key that has more occurrences; sorted by key."""
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    total = np.add.reduceat(often, first, dtype=np.int64)
    many[order] = np.repeat(total > heavy, np.diff(np.append(first, len(order))))


def _shared(keys: np.ndarray, checks: np.ndarray, found: np.ndarray, order: np.ndarray) -> None:
    """Mark all that share a key of which there are two checks, or one marked already; sorted by key and check."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(first, len(keys)))
    mixed = (checks[first] != checks[first + size - 1]) | np.logical_or.reduceat(found[order], first)
    found[order] = np.repeat(mixed, size)


_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


#: Arrays are hashed so many numbers at a time, which stay in the processor's cache.
_RUN = 1 << 14


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in their order."""
    if len(a) > _RUN:
        out, each = np.empty(len(a), dtype=np.uint64), len(b) > 1
        for i in range(0, len(a), _RUN):
            out[i : i + _RUN] = mix(a[i : i + _RUN], b[i : i + _RUN] if each else b)
        return out
    x = a * _K1
    x ^= x >> np.uint64(32)
    x += b
    x *= _K2
    x ^= x >> np.uint64(29)
    x *= _K3
    x ^= x >> np.uint64(32)
    return x


def spread(h: np.ndarray) -> np.ndarray:
    """Keys of hashes that were chosen for being small, one to one and even over all ranges."""
    return mix(h, np.zeros(1, dtype=np.uint64))


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def first_bytes(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each span, zeros behind its end; 8 bytes must follow each start."""
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    return eight[starts] & _MASKS.take(np.minimum(length, 8))


def hash_spans(data: np.ndarray, starts: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the bytes of each span; 8 bytes must follow the last one."""
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    hashes = mix(eight[starts] & _MASKS.take(np.minimum(length, 8)), length.astype(np.uint64) + np.uint64(seed))
    more, at, left = np.arange(len(starts)), starts, length
    while True:
        long = np.flatnonzero(left > 8)
        if not len(long):
            return hashes
        more, at, left = more[long], at[long] + 8, left[long] - 8
        hashes[more] = mix(hashes[more], eight[at] & _MASKS.take(np.minimum(left, 8)))


_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes but ASCII white space), and the number of each text's first word and the end."""
    data = np.frombuffer(b" ".join([b"", *raw, b" " * 8]), dtype=np.uint8)
    space = _SPACE.take(data)
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    length = np.flatnonzero(~space[:-1] & space[1:]) + 1 - starts
    offsets = np.cumsum([1, *(len(t) + 1 for t in raw)])
    return hash_spans(data, starts, length), np.searchsorted(starts, offsets)


class Digests(dict):
    """A number for each word, by first use, and its digest under a key that nobody who chooses texts knows."""

    def __init__(self, key: bytes, size: int):
        self.key, self.size, self.found = key, size, []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.found.append(hashlib.blake2b(word, digest_size=self.size, key=self.key).digest())
        return n

    def numbers(self, text: bytes) -> np.ndarray:
        """Those of the words of a text."""
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def lanes(self) -> np.ndarray:
        """The digests, a row each."""
        return np.frombuffer(b"".join(self.found), np.uint64).reshape(len(self.found), -1)


def keyed_word_hashes(raw: list[bytes], key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, of digests: for what is decided by hashes alone."""
    of = Digests(key, 8)
    numbers = [of.numbers(t) for t in raw]
    ends = np.cumsum([0, *map(len, numbers)])
    return of.lanes()[:, 0].take(np.concatenate(numbers)) if ends[-1] else np.zeros(0, np.uint64), ends


def halves(n: int) -> list[int]:
    """1, and so on up to n, each at most twice the one before: n = 35 gives 1, 2, 3, 5, 9, 18, 35."""
    return [*halves((n + 1) // 2), n] if n > 1 else [1]


def doubled(h: np.ndarray, short: int, long: int) -> np.ndarray:
    """Hashes of windows of ``long`` from those of ``short`` at their two ends."""
    n = len(h) - (long - short)
    return mix(h[:n], h[long - short :]) if n > 0 else h[:0]


#: The low half of a number in which ``least_at`` counts places: fixed, so that blocks of any size choose alike.
_PLACE = np.uint64((1 << 32) - 1)


def least_at(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the place of the least, by its high 32 bits (the first, of equal ones).

    The choice depends on the window alone, so equal windows choose alike wherever they stand.
    """
    if len(h) < width:
        return np.zeros(0, dtype=np.int64)
    out = np.empty(len(h) - width + 1, dtype=np.int64)
    for i in range(0, len(out), 4 * _RUN):
        x = h[i : i + 4 * _RUN + width - 1] & ~_PLACE
        x |= np.arange(i, i + len(x), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            x, span = np.minimum(x[:-span], x[span:]), span * 2
        if span < width:
            x = np.minimum(x[: len(x) - (width - span)], x[width - span :])
        out[i : i + 4 * _RUN] = x & _PLACE
    return out
