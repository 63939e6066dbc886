"""Suffix arrays by linear grouping, and the dedup of long byte strings that uses them.

``suffix_array`` builds the array in two phases, without renaming or recursion.
First suffixes are put in groups by their Lyndon prefix: groups are processed
in descending order; each suffix points to the previous one that lies in a
smaller group, and those pointed to move up within their own group, the further
the more often they are pointed to.  Then the groups' order is emitted from the
smallest suffix on, each placing the suffixes that end right before it.

``suffix_dedup`` removes every byte covered by a string of ``length`` bytes that
also starts earlier.  Each such string is stood for by its anchor: the 32-byte
gram within it whose hash is least, which equal strings choose alike.  Strings
whose anchors occur once are unique.  The rest go, with the text around their
anchor, to the shard of the anchor's hash, so that equal strings meet.  Of an
anchor that occurs very often, only strings whose own hash repeats are sent.

A shard's records are taken in parts by their anchors, whose number bounds the memory
of an array.  They are recoded into symbols of 12 bytes that keep their order, on
a grid through the anchor, and the suffix array of a part is built, with
the lengths of common prefixes in bytes.  A string is a short head and a suffix
at a place of the grid: strings are equal if their suffixes lie in one run of
the array, with common prefixes long enough, and the bytes of their heads are
equal.  No hash decides; the earliest of each class stays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import blocks as B
from millrace.llm.scratch import materialize, session, tidied

LENGTH = 100
GRAM = 32
#: Bytes of a symbol, 16 at most.
SYMBOL = 12
#: Shards for each range of keys, taken one after another: a shard's suffix array is in memory.
SHARDS = 4
#: Symbols of a suffix array, about, unless one anchor's records alone have more: a shard's anchors are taken in parts.
PART_SYMBOLS = 1 << 19
#: An anchor that occurs more often than this sends only those of its strings that repeat by their own hash.
HOT = 4096
_LATER = (1 << 63) - 1


def suffix_array(text: Sequence[int]) -> list[int]:
    """The order of the suffixes of a sequence of positive integers; an end that sorts first is implied."""
    codes = np.asarray(text, dtype=np.int64)
    n = len(codes) + 1
    codes = np.append(codes, codes.min(initial=1) - 1)
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=codes[order[0]] - 1))
    size = np.zeros(n, dtype=np.int64)
    size[starts] = np.diff(np.append(starts, n))
    group = np.empty(n, dtype=np.int64)
    group[order] = np.repeat(starts, size[starts])
    sa, size, group = order.tolist(), size.tolist(), group.tolist()
    place = np.argsort(order).tolist()
    smaller = [-1] * n  # the previous suffix in a smaller group
    end = n - 1
    while end > 0:
        first = group[sa[end]]
        if first == end:  # a group of one, the usual case
            p = sa[end] - 1
            while p >= 0 and group[p] >= first:
                p = smaller[p]
            smaller[sa[end]] = p
            if p >= 0:
                g = group[p]
                k = size[g] - 1
                if k:
                    last = g + k
                    other, at = sa[last], place[p]
                    sa[at], place[other] = other, at
                    sa[last], place[p] = p, last
                    size[g], size[last], group[p] = k, 1, last
            end = first - 1
            continue
        pointed: dict[int, int] = {}
        for s in sorted(sa[first : end + 1]):
            p = s - 1
            while p >= 0 and group[p] >= first:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        rank: dict[int, list[int]] = {}
        for p, times in pointed.items():
            rank.setdefault(times, []).append(p)
        for times in sorted(rank, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in rank[times]:
                moved.setdefault(group[p], []).append(p)
            for g, members in moved.items():
                left = size[g] - len(members)
                if not left:
                    continue
                last = g + size[g]
                for p in members:  # to the end of their group, which then is a group of its own
                    last -= 1
                    other, at = sa[last], place[p]
                    sa[at], place[other] = other, at
                    sa[last], place[p] = p, last
                size[g], size[g + left] = left, len(members)
                for p in members:
                    group[p] = g + left
        end = first - 1
    free, out = list(range(n)), [n - 1] + [-1] * (n - 1)  # free: by a group's start, its next place
    done = [False] * n
    done[n - 1] = True
    for s in range(n):
        p = out[s] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            done[p] = True
            p = smaller[p]
    return out[1:]


def _eight(data: np.ndarray) -> np.ndarray:
    """The number in the 8 bytes at each place."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def _gram(eight: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """A hash of the 32 bytes at each place."""
    if isinstance(at, slice):
        at = [eight[at.start + i : at.stop + i] for i in (0, 8, 16, 24)]
    else:
        at = [eight[at + i] for i in (0, 8, 16, 24)]
    return B.mix(B.mix(*at[:2]), B.mix(*at[2:]))


def _joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends."""
    texts = [t.as_py() or b"" for t in table.column("text").combine_chunks().cast(pa.binary())]
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])


def _anchors(table: pa.Table, length: int) -> pa.Table:
    """Runs of strings of one anchor: the bytes skipped before the first, how many, and how far from it the anchor is."""
    data, ends = _joined(table)
    n = len(data) - GRAM + 1
    anchors = B.least_at(_gram(_eight(data), slice(0, n)), length - GRAM + 1) if n > 0 else np.zeros(0, np.int64)
    new = np.ones(len(anchors) + 1, dtype=bool)
    new[1:-1] = anchors[1:] != anchors[:-1]
    for i in ends[1:-1].tolist():  # strings that cross the end of a document are left out
        new[max(0, i - length + 1)] = new[min(i, len(anchors))] = True
    first = np.flatnonzero(new)
    from_, stop = first[:-1], first[1:]
    inside = np.searchsorted(ends, from_, "right") == np.searchsorted(ends, from_ + length - 1, "right")
    from_, stop = from_[inside], stop[inside]
    skipped = from_ - np.concatenate([[0], stop])[: len(from_)]
    columns = {"skipped": skipped.astype(np.uint32), "count": (stop - from_).astype(np.uint8), "lead": (anchors[from_] - from_).astype(np.uint8)}
    return pa.table({name: pa.array(x) for name, x in columns.items()})


class _Block:
    """A block's bytes, its runs of strings of one anchor, and the records of those that may repeat."""

    def __init__(self, payload: bytes, length: int):
        self.table, runs = B.unpack_both(payload)
        self.length, (self.data, self.ends) = length, _joined(self.table)
        self.count = runs.column("count").to_numpy().astype(np.int64)
        self.from_ = np.cumsum(runs.column("skipped").to_numpy().astype(np.int64) + self.count) - self.count
        self.at = self.from_ + runs.column("lead").to_numpy()
        self.eight = _eight(self.data) if len(self.at) else np.zeros(0, np.uint64)
        keys = B.spread(_gram(self.eight, self.at))
        self.keys, self.back, self.copies = np.unique(keys, return_inverse=True, return_counts=True)

    def hot(self, given: list[dict]) -> None:
        """Find the strings of anchors that occur very often, and the hash of each."""
        runs = np.flatnonzero(B.heavy_bits(given, len(self.keys))[self.back])
        n = self.count[runs]
        self.hot_run = np.repeat(runs, n)
        self.hot_at = s = np.arange(int(n.sum())) + np.repeat(self.from_[runs] - (np.cumsum(n) - n), n)
        last, h = self.length - GRAM, lambda at: _gram(self.eight, at)
        hashed = B.mix(h(s), h(s + last)) if last < GRAM else B.mix(B.mix(h(s), h(s + GRAM)), B.mix(h(s + last - GRAM), h(s + last)))
        self.hot_keys, self.hot_back, self.hot_copies = np.unique(hashed, return_inverse=True, return_counts=True)

    def records(self, given: list[list[dict]]) -> None:
        """Keep the strings that may repeat: a record is a run of strings of one anchor, first to last start."""
        anchors = given[0] if given else []
        alive = B.bits(anchors, len(self.keys))[self.back]
        self.hot(anchors)
        self.key = self.keys[self.back]
        if len(self.hot_keys):  # their runs are those of their strings that repeat
            alive[self.hot_run] = False
            some = B.bits(given[1] if len(given) > 1 else [], len(self.hot_keys))[self.hot_back]
            run, start = self.hot_run[some], self.hot_at[some]
            new = np.ones(len(run) + 1, dtype=bool)
            new[1:-1] = (run[1:] != run[:-1]) | (start[1:] != start[:-1] + 1)
            first = np.flatnonzero(new)
            run, start, count = run[first[:-1]], start[first[:-1]], np.diff(first)
        else:
            run = start = count = np.zeros(0, np.int64)
        alive = np.flatnonzero(alive)
        self.from_, self.count = np.concatenate([self.from_[alive], start]), np.concatenate([self.count[alive], count])
        run = np.concatenate([alive, run])
        order = np.argsort(self.from_, kind="stable")
        self.from_, self.count, run = self.from_[order], self.count[order], run[order]
        self.at, self.key = self.at[run], self.key[run]
        raw, tail = self.data.tobytes(), self.length - 1
        seen: dict[tuple[bytes, int], int] = {}
        copy = np.zeros(len(self.at), dtype=bool)
        self.strings: list[bytes] = []
        for i, (p, n, a) in enumerate(zip(self.from_.tolist(), self.count.tolist(), self.at.tolist(), strict=True)):
            string = raw[p : p + n + tail]
            if seen.setdefault((string, a - p), i) != i:  # an earlier record of this block is the same
                copy[i] = True
            else:
                self.strings.append(string)
        self.copy = copy


def _shard(rows: list[dict], length: int) -> list[bytes]:
    """For each row's records, which of their strings start earlier elsewhere: 96 bits a record.

    Equal strings have equal anchors, so the records are taken in parts by the hash of their anchor; only
    their bytes are in memory together.
    """
    columns = [B.unpack(r["payload"]) for r in rows]
    sizes = [t.num_rows for t in columns]
    strings = pa.concat_arrays([t.column("string").combine_chunks().cast(pa.large_binary()) for t in columns])
    lead, count = (np.concatenate([t.column(c).to_numpy() for t in columns]).astype(np.int64) for c in ("lead", "count"))
    doc, pos = (np.concatenate([t.column(c).to_numpy() for t in columns]) for c in ("doc", "pos"))
    del columns
    block = np.repeat([r["block"] for r in rows], sizes)
    early = np.lexsort((pos, block, doc))
    gone = np.ones((len(strings), 96), dtype=bool)  # by record, and by place of the string in it
    for part in _parts(strings, lead, early):
        # records with the same bytes: the earliest stands for them
        kept: dict[tuple[bytes, int], int] = {}
        for i, string, d in zip(part.tolist(), strings.take(pa.array(part)).to_pylist(), lead[part].tolist(), strict=True):
            kept.setdefault((string, d), i)
        alone = list(kept.values())
        gone[alone] = False
        _mark([string for string, _ in kept], lead[alone], count[alone], alone, gone, length)
    gone &= np.arange(96) < count[:, None]
    out = np.packbits(gone, axis=1)
    ends = np.cumsum(sizes).tolist()
    return [out[i:j].tobytes() for i, j in zip([0, *ends], ends, strict=False)]


def _parts(strings: pa.Array, lead: np.ndarray, order: np.ndarray) -> Iterator[np.ndarray]:
    """The records in parts of about PART_SYMBOLS, those of one anchor together, each in the given order."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[: len(strings) + 1]
    anchors = _gram(_eight(np.frombuffer(strings.buffers()[2], np.uint8)), offsets[:-1] + lead)
    many = -(-int((np.diff(offsets) // SYMBOL + 2).sum()) // PART_SYMBOLS)
    part = ((B.spread(anchors[order]) >> np.uint64(32)) * np.uint64(many) >> np.uint64(32)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[by], np.arange(many + 1)).tolist()
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i < j:
            yield order[by[i:j]]


def _common(eight: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many of the bytes from places a and b on are equal, ``most`` at most."""
    out, left = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    for at in range(0, most, 8):
        apart = eight[a[left] + at] ^ eight[b[left] + at]
        here = apart != 0
        low = apart[here] & (~apart[here] + np.uint64(1))
        out[left[here]] = at + (np.bitwise_count(low - np.uint64(1)) >> 3)
        left = left[~here]
    out[left] = most
    return np.minimum(out, most)


def _mark(strings: list[bytes], lead: np.ndarray, count: np.ndarray, row: list[int], gone: np.ndarray, length: int):
    """Mark the strings of distinct records, earliest first, that equal one of an earlier record."""
    pad = b"\0" * (length + 24)
    data = np.frombuffer(pad + pad.join(strings) + pad, dtype=np.uint8)
    eight, size = _eight(data), np.fromiter(map(len, strings), np.int64, len(strings))
    begin = np.cumsum(size + len(pad)) - size
    # the places of the grid: a record's k-th is grid + k * SYMBOL
    grid = lead % SYMBOL
    each = -(-(size - grid) // SYMBOL)
    record = np.repeat(np.arange(len(strings)), each)
    k = np.arange(len(record)) - np.repeat(np.cumsum(each) - each, each)
    inside = grid[record] + k * SYMBOL
    at = begin[record] + inside
    # symbols by the order of their bytes; behind a record's end they are zeros, which follow it in ``data`` too
    big = data[np.add.outer(at, np.arange(16))]
    big[:, SYMBOL:] = 0
    high, low = big.view(">u8").astype(np.uint64).T
    order = np.lexsort((low, high))
    step = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
    text = np.ones(len(record) + len(strings), dtype=np.int64)  # 1 ends each record
    slot = np.arange(len(record)) + record
    text[slot[order]] = np.concatenate([[0], np.cumsum(step)]) + 2
    sa = np.array(suffix_array(text), dtype=np.int64)
    of = np.full(len(text), -1)
    of[slot] = np.arange(len(record))
    by = of[sa]
    by = by[by >= 0]  # the grid's places, in the order of what follows them
    common = _common(eight, at[by[:-1]], at[by[1:]], length)
    inside, record, at, count = inside[by], record[by], at[by], count[record[by]]
    for head in range(SYMBOL):
        # strings that start ``head`` bytes before a place of the grid
        cut = common < length - head
        here = (inside >= head) & (inside - head < count)
        here &= ~(np.concatenate([[True], cut]) & np.concatenate([cut, [True]]))  # not alone in its run
        here = np.flatnonzero(here)
        if not len(here):
            continue
        run, bits = np.concatenate([[0], np.cumsum(cut)])[here], np.uint64(64 - 8 * min(head, 8))
        near = eight[at[here] - 8] >> bits if head else np.zeros(len(here), np.uint64)
        keys = [near, run]
        if head > 8:
            keys.insert(0, eight[at[here] - 16] >> np.uint64(8 * (16 - head)))
        order = np.lexsort(keys)
        new = np.concatenate([[True], np.any([x[order[1:]] != x[order[:-1]] for x in keys], axis=0)])
        first = np.flatnonzero(new)
        mine = record[here[order]]
        least = np.repeat(np.minimum.reduceat(mine, first), np.diff(np.append(first, len(order))))
        later = here[order[mine != least]]
        gone[np.asarray(row)[record[later]], inside[later] - head] = True


def suffix_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, text) -> (doc_id, n_bytes, n_removed, spans, kept, c0...), one row per input row.

    Texts are their UTF-8 bytes, null ones empty.  Every byte covered by a string
    of ``length`` bytes (33 to 127) of one document that also starts earlier, by
    smaller id or in the same document further left, is removed; strings may
    overlap and are judged on the input.  spans are the maximal removed runs as
    [start, stop); kept is the bytes that remain, which need not be whole
    characters.  A null id comes after all others; among rows that share an id, the
    order is that of the blocks they are read in, so one of repeated rows stays
    whole.  An empty table gives an empty result.  A very long text is a block by
    itself, in memory about 40 times in each pass.  Columns named in ``carry`` come back
    as c0, c1..., whatever their names; others are ignored.
    """
    if not GRAM < length < GRAM + 96:
        raise ValueError(f"length must be 33 to 127, not {length}")
    session(docs)
    store = B.write_blocks(docs, id_col, text_col, carry, also=lambda table: _anchors(table, length))
    n = B.ranges(store)

    def first(block: int, payload: bytes, given: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        b = _Block(payload, length)
        yield from B.ask(block, b.keys, None, b.copies > 1, n, b.copies)

    asks = B.by_block(store, None, first, B.ASKS)
    answers = anchors = materialize(B.repeated(asks, 0, n, heavy=HOT), "anchors")
    hot = anchors.where(F.octet_length("payload") > F.expr("(n + 7) div 8")).select("block").distinct()
    if not hot.isEmpty():

        def strings(block: int, payload: bytes, given: list[list[dict]]) -> Iterator[pa.RecordBatch]:
            b = _Block(payload, length)
            b.hot(given[0])
            yield from B.ask(block, b.hot_keys, None, b.hot_copies > 1, n)

        some = [x.join(hot, "block", "left_semi") for x in (store, anchors)]
        asks = B.by_block(some[0], some[1], strings, B.ASKS)
        answers = anchors.union(materialize(B.repeated(asks, 1, n), "strings"))

    def second(block: int, payload: bytes, given: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        b = _Block(payload, length)
        b.records(given)
        own = np.flatnonzero(~b.copy)
        if not len(own):
            return
        bucket = (b.key[own] >> np.uint64(32)) * np.uint64(n * SHARDS) >> np.uint64(32)
        ids = b.table.column("doc_id").combine_chunks().fill_null(_LATER).to_numpy()
        doc = np.searchsorted(b.ends, b.from_[own], "right") - 1
        whole = pa.table(
            {
                "string": pa.array(b.strings, pa.binary()),
                "lead": pa.array((b.at - b.from_)[own].astype(np.uint8)),
                "count": pa.array(b.count[own].astype(np.uint8)),
                "doc": pa.array(ids[doc]),
                "pos": pa.array(b.at[own]),
            }
        )
        order = np.argsort(bucket, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1)), len(order))
        for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            part = whole.take(pa.array(order[i:j])).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[order[i]])], pa.int32()), pa.array([block]), pa.array([B.pack(part)], pa.binary())],
                names=["bucket", "block", "payload"],
            )

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in B.groups(batches, "bucket"):
            masks = _shard(rows, length)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["block"] for r in rows]),
                    pa.array([2] * len(rows), pa.int32()),
                    pa.array([bucket] * len(rows), pa.int32()),
                    pa.array([len(m) // 12 for m in masks], pa.int32()),
                    pa.array(masks, pa.binary()),
                ],
                names=["block", "level", "bucket", "n", "payload"],
            )

    records = B.by_block(store, answers, second, "bucket int, block long, payload binary")
    shards = records.repartition(n, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(tidied(shard), B.ANSWERS)
    answers = answers.union(materialize(shards, "shards"))

    fields = B.carried_fields(docs, carry)
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("kept", T.BinaryType()),
            *fields,
        ]
    )

    def finish(block: int, payload: bytes, given: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        b = _Block(payload, length)
        b.records(given)
        marks = np.ones((len(b.at), 96), dtype=np.uint8)  # a copy within the block goes wholly
        own = np.flatnonzero(~b.copy)
        if len(own):
            bucket = (b.key[own] >> np.uint64(32)) * np.uint64(n * SHARDS) >> np.uint64(32)
            raw = np.frombuffer(b"".join(r["payload"] for r in given[2]), np.uint8).reshape(-1, 12)
            marks[own[np.argsort(bucket, kind="stable")]] = np.unpackbits(raw, axis=1)
        hit = (marks > 0) & (np.arange(96) < b.count[:, None])
        rows, places = np.nonzero(hit)
        starts = b.from_[rows] + places
        edge = np.bincount(starts, minlength=len(b.data) + 1)[: len(b.data) + 1]
        edge = edge - np.bincount(starts + length, minlength=len(b.data) + 1)[: len(b.data) + 1]
        gone = np.cumsum(edge)[:-1] > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = before[b.ends[1:]] - before[b.ends[:-1]]
        raw, spans, kept = b.data.tobytes(), [], []
        for i, (lo, hi) in enumerate(zip(b.ends.tolist(), b.ends[1:].tolist(), strict=False)):
            if not removed[i]:
                spans.append([])
                kept.append(raw[lo:hi])
                continue
            cuts = np.flatnonzero(np.diff(np.concatenate([[0], gone[lo:hi].view(np.int8), [0]])))
            spans.append(cuts.reshape(-1, 2).tolist())
            kept.append(b.data[lo:hi][~gone[lo:hi]].tobytes())
        columns = [
            b.table.column("doc_id").combine_chunks(),
            pa.array(np.diff(b.ends).astype(np.int64)),
            pa.array(removed.astype(np.int64)),
            pa.array(spans, pa.list_(pa.list_(pa.int64()))),
            pa.array(kept, pa.binary()),
            *[b.table.column(B.carried_column(i, carry, text_col)).combine_chunks() for i in range(len(fields))],
        ]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return B.by_block(store, answers, finish, schema)
