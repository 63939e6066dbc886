"""Adaptive context-mixing range coder for token ids.

A block of ids is coded by itself: its model starts anew and its checksum is its
own.  Three models predict the next id.  Order 0 has counts of the ids so far in
the block over a prior, which the header has: about how often each id occurs in
the call.  Order 1 and order 2 each propose the id that followed last time after
the same one or two ids, with a confidence of 0 to 3 by how often it has held.
The distribution that is coded is their mixture: order 0's, and a point at each
proposed id, weighed by how often each was right so far in the block under the
present pair of confidences.  A proposed id is coded by its points alone.

Weights are reckoned anew after 64, 128, 256 ids and so on, at most STEP apart,
order 0's counts whenever the ids have doubled; orders 1 and 2 adapt with every
id.  Ids are coded as their ranks among the distinct ids of the call, which the
header lists.  A long block is read in several ways at once, at equal distances,
which share its model and have a stream of words each.  All ways of up to LANES
blocks go in lockstep, one numpy lane each; a block holds nothing of another, so
that with the header any block can be decoded alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 14
#: Blocks that go in lockstep, at most, and the ways of a block.
LANES, WAYS = 128, 32
#: Ids of a block of a short call, at least, and lanes that a call is to have.
SHORT, FEW = 1 << 10, 64
#: Ids of a way, at least.
WAY = 1 << 9
#: Ids between two tables of weights, at most.
STEP = 1024
#: Ids before which order 0 is counted anew, first; then whenever they have doubled.
COUNTED = 2048
MAGIC = b"MRT3"
#: What an id adds to its count, and the weight of the prior in all.
_GROWTH, _PRIOR = 64, 1 << 18
_SLOTS = 15  #: bits of the index of order 2
_SHARE = 12  #: bits of the weights' sum
_TOP = np.uint64((1 << 64) - 1)
_UNSET = 0xFFFFFFFC  #: an entry of order 1 or 2 that proposes nothing: no call has so many distinct ids
_ONE, _THREE = np.int8(1), np.int8(3)
#: Weights to start from, by confidence: of order 2, of order 1, and of order 0.
_FIRST2, _FIRST1, _FIRST0 = (0, 4, 8, 16), (0, 2, 4, 8), 8
_CREDIT = 4
_MIX1, _MIX2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: Four logarithms to a doubling, as the header has them -> about so many.
_ABOUT = np.array([round(16 * 2 ** (q / 4)) for q in range(128)])


def _tables(n: int) -> list[int]:
    """The ids before which weights are reckoned anew, up to n."""
    out, at = [0], 64
    while at < n:
        out.append(at)
        at += min(at, STEP)
    return out


def _places(size: int) -> int:
    """Bits of order 0's total: eight places for an id, two at least."""
    return max(8, (8 * size - 1).bit_length()) if size <= 1 << 15 else max(18, (2 * size - 1).bit_length())


def _word(size: int) -> tuple[int, int, str]:
    """Bits of a word of the range coder, how many of them an id can take, and their kind."""
    return (32, 1, "<u4") if _places(size) + _SHARE <= 30 else (16, 3, "<u2")


class _Model:
    """The state of every block and of its ways, block by block; ids are ranks below ``size``."""

    def __init__(self, blocks: int, ways: int, size: int, about: np.ndarray | None, table: np.ndarray, find: bool):
        self.size, self.blocks, self.ways, self.table, self.done = size, blocks, ways, table, 0
        about = np.ones(size, dtype=np.int64) if about is None else about
        self.prior = 1 + about * _PRIOR // int(about.sum())
        self.bits = _places(size)
        self.total = np.uint64(self.bits + _SHARE)
        self.kind = np.int32 if self.bits + _SHARE <= 30 else np.int64  # of places in the mixture
        block = np.repeat(np.arange(blocks), ways)
        self.row0, self.row1, self.row2, self.row64 = block * (size + 1), block * size, block << _SLOTS, block << 6
        self.places = block << self.bits
        self.cumulated = np.zeros((blocks, size + 1), dtype=np.int32)
        kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.ranks = np.arange(size, dtype=kind)
        self.slots = np.zeros((blocks, 1 << self.bits), dtype=kind) if find else None
        self.one, self.two = np.full(blocks * size, _UNSET, dtype=np.uint32), np.full(blocks << _SLOTS, _UNSET, dtype=np.uint32)
        first = [(_FIRST0, _FIRST1[b], _FIRST2[a]) for a in range(4) for b in range(4)]
        self.credits = np.tile(np.array(first), (blocks, 1))  # by block and confidences, then order
        self.last = np.zeros(len(block), dtype=np.uint32)
        self.mixed = np.zeros(len(block), dtype=np.uint32)
        self.seen = np.zeros((STEP, len(block)), dtype=np.int64)
        self.n_seen = 0

    def cumulate(self) -> None:
        """Count the ids so far, and order 0 anew."""
        whole = 1 << self.bits
        for i in range(self.blocks):
            weight = self.prior
            if self.done:
                own = self.table[: self.done, i * self.ways : (i + 1) * self.ways]
                weight = weight + _GROWTH * np.bincount(own.ravel(), minlength=self.size)
            elif i:
                self.cumulated[i] = self.cumulated[0]
                if self.slots is not None:
                    self.slots[i] = self.slots[0]
                continue
            # an id has as much as gives it one place, at least
            sums = np.cumsum(np.maximum(weight, -(-int(weight.sum()) // (whole - self.size))))
            self.cumulated[i, 1:] = (sums << self.bits) // int(sums[-1])
            if self.slots is not None:
                self.slots[i] = np.repeat(self.ranks, np.diff(self.cumulated[i]))
        self.flat = self.cumulated.ravel()
        self.flat_slots = None if self.slots is None else self.slots.ravel()

    def weigh(self) -> None:
        """Count what was right since the last time, and the weights anew."""
        if self.n_seen:
            n = np.bincount(self.seen[: self.n_seen].ravel(), minlength=self.blocks << 6).reshape(-1, 4)
            self.credits += _CREDIT * np.column_stack([n[:, 0], n[:, 1], n[:, 2] + n[:, 3]])
            self.n_seen = 0
        # two less than all of it, so that something is left for order 0 when both have the one part that they need
        share = self.credits[:, 1:] * ((1 << _SHARE) - 2) // self.credits.sum(axis=1)[:, None]
        one, two = np.maximum(share, self.credits[:, 1:] > 0).T
        none, points1, points2 = np.zeros_like(one), one << self.bits, two << self.bits
        both = points1 + points2
        # by block, confidences and what is right (none, order 1, order 2, both): where the id begins, its points, order 0's weight
        tables = (both, points2, none, none), (none, points1, points2, both), ((1 << _SHARE) - one - two, none, none, none)
        self.begin, self.points, self.weight = (np.column_stack(x).astype(self.kind).ravel() for x in tables)

    def predict(self) -> None:
        """Proposed ids and their confidences."""
        self.at1 = self.row1 + self.last
        mixed = self.last * _MIX2
        mixed += self.mixed
        mixed >>= 32 - _SLOTS
        self.at2 = self.row2 + mixed
        self.e1, self.e2 = self.one.take(self.at1, mode="clip"), self.two.take(self.at2, mode="clip")
        self.sure1, self.sure2 = (self.e1 & 3).astype(np.int8), (self.e2 & 3).astype(np.int8)
        self.context = (self.sure2 << 4) + (self.sure1 << 2)

    def span(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each lane's id begins in the mixture, and its share; points of order 2 come first, then of order 1, then order 0."""
        self.entry = entry = ids << 2
        self.is1, self.is2 = ((self.e1 ^ entry) < 4).view(np.int8), ((self.e2 ^ entry) < 4).view(np.int8)
        at = np.add(self.row64, self.context + (self.is2 << 1) + self.is1, out=self.seen[self.n_seen])
        weight, place = self.weight.take(at, mode="clip"), self.row0 + ids
        start = self.flat.take(place, mode="clip")
        place += 1
        size = self.flat.take(place, mode="clip")
        size = (size - start) * weight
        size += self.points.take(at, mode="clip")
        start = start * weight
        start += self.begin.take(at, mode="clip")
        return start.astype(np.uint64), size.astype(np.uint64)

    def find(self, found: np.ndarray) -> np.ndarray:
        """The id of each lane whose span holds this place of the mixture."""
        found = np.minimum(found, np.uint64((1 << int(self.total)) - 1)).astype(self.kind)
        at = self.row64 + self.context
        behind, weight = self.begin.take(at, mode="clip"), self.weight.take(at, mode="clip")
        at += 1
        place = ((found - behind) / weight).astype(np.int64)
        place += self.places
        ids = self.flat_slots.take(place, mode="clip").astype(np.uint32)
        ids = np.where(found < behind, self.e1 >> 2, ids)
        return np.where(found < self.begin.take(at, mode="clip"), self.e2 >> 2, ids)

    def update(self, ids: np.ndarray) -> None:
        # 1 for another id, one more than before (3 at most) for the same
        self.two[self.at2] = self.entry + np.minimum(self.sure2 * self.is2 + _ONE, _THREE).view(np.uint8)
        self.one[self.at1] = self.entry + np.minimum(self.sure1 * self.is1 + _ONE, _THREE).view(np.uint8)
        self.mixed, self.last = self.last * _MIX1, ids
        self.n_seen += 1


def _steps(model: _Model, n: int) -> Iterator[int]:
    """Steps 0 to n, with the model ready to be asked at each."""
    tables = {-(-x // model.ways) for x in _tables(n * model.ways)}
    counted = {0, *(-(-(COUNTED << i) // model.ways) for i in range(15))}
    for step in range(n):
        if step in tables:
            model.done = step
            model.weigh()
            if step in counted:
                model.cumulate()
        model.predict()
        yield step


def _encode_lanes(table: np.ndarray, size: int, about: np.ndarray | None = None, ways: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by step and lane -> words of each lane, and all of them, lane by lane."""
    (n, lanes), (bits, most, kind) = table.shape, _word(size)
    model = _Model(lanes // ways, ways, size, about, table, find=False)
    limit, shift_of, at = np.uint64(1 << 64 - bits), np.uint64(bits), np.uint64(64 - bits)
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, _TOP, dtype=np.uint64)
    # rows for each step, of which each lane fills some, and whether a step carries into a lane's word before
    words = np.zeros((n * most + 1, lanes), dtype=kind)
    filled, carries = np.zeros(words.shape, dtype=bool), np.zeros((n + 1, lanes), dtype=bool)
    row = 0
    for step in _steps(model, n):
        start, share = model.span(table[step])
        span >>= model.total
        start *= span
        low += start
        span *= share
        np.less(low, start, out=carries[step])
        for _ in range(most):
            more = filled[row]
            np.less(span, limit, out=more)
            words[row] = low >> at
            shift = np.multiply(more, shift_of, dtype=np.uint64)
            low <<= shift
            span <<= shift
            row += 1
        model.update(table[step])
    # the first place of the span that ends in zeros but for a word
    low += (limit - np.uint64(1))
    np.less(low, limit - np.uint64(1), out=carries[n])
    words[row], filled[row] = low >> at, True
    row += 1
    filled = np.ascontiguousarray(filled.T)
    count, kept = filled.sum(axis=1), words.T[filled].astype(np.uint64)
    before = np.cumsum(filled.ravel(), dtype=np.int64)
    step, lane = np.nonzero(carries)
    np.add.at(kept, before[lane * row + step * most] - filled[lane, step * most] - 1, np.uint64(1))
    ends = np.cumsum(count)
    while (over := kept >> shift_of).any():
        kept &= np.uint64((1 << bits) - 1)
        over[ends[:-1]] = 0  # a lane's first word is below 1, so nothing is carried out of it
        kept[:-1] += over[1:]
    return count, kept.astype(kind)


def _decode_lanes(
    flat: np.ndarray, count: np.ndarray, n: int, size: int, about: np.ndarray | None = None, ways: int = 1
) -> np.ndarray:
    """The ranks by step and lane of what ``_encode_lanes`` gave."""
    lanes, (bits, most, _) = len(count), _word(size)
    # first words of all lanes, then second ones, as they are read; zeros behind the last
    words = np.zeros((int(count.max()) + 1, lanes), dtype=np.uint64)
    words.T[np.arange(len(words)) < count[:, None]] = flat
    words, at = words.ravel(), np.arange(lanes)
    table = np.zeros((n, lanes), dtype=np.uint32)
    model = _Model(lanes // ways, ways, size, about, table, find=True)
    limit, shift_of = np.uint64(1 << 64 - bits), np.uint64(bits)
    span, code = np.full(lanes, _TOP, dtype=np.uint64), np.zeros(lanes, dtype=np.uint64)
    for _ in range(64 // bits):
        code = (code << shift_of) | words.take(at, mode="clip")
        at += lanes
    for step in _steps(model, n):
        span >>= model.total
        ids = model.find(code // span)
        start, share = model.span(ids)
        start *= span
        code -= start
        span *= share
        for _ in range(most):
            more = (span < limit).astype(np.uint64)
            shift = more * shift_of
            span <<= shift
            code <<= shift
            code |= words.take(at, mode="clip") * more
            at += more.view(np.int64) * lanes
        model.update(ids)
        table[step] = ids
    return table


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, in order, the rank of each id among them, and how often each occurs."""
    if not len(ids) or int(ids.max()) >= 1 << 20:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    known = np.flatnonzero(counts).astype(np.uint32)
    rank = np.zeros(int(known[-1]) + 1, dtype=np.uint32)
    rank[known] = np.arange(len(known), dtype=np.uint32)
    return known, rank.take(ids), counts[known]


def block_for(n: int) -> int:
    """Ids of a block in a call with n of them: a call of few ids takes shorter blocks, since a step costs as much for few lanes."""
    return min(BLOCK, max(SHORT, -(-n // FEW)))


def ways_for(block: int) -> int:
    """The ways in which a block is read at once."""
    return max(1, min(WAYS, block // WAY))


def _table(ranks: np.ndarray, block: int, ways: int) -> np.ndarray:
    """Ranks of some blocks -> by step and lane, a lane for each way; zeros behind the last."""
    n = min(block, len(ranks))
    lanes, steps = -(-len(ranks) // block), -(-n // ways)
    held = np.zeros((lanes, n), dtype=np.uint32)
    held.ravel()[: len(ranks)] = ranks
    table = np.zeros((lanes, steps * ways), dtype=np.uint32)
    table[:, :n] = held
    return np.ascontiguousarray(table.reshape(lanes * ways, steps).T)


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Ids (unsigned, below 2**30) as blocks with checksums."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >= 1 << 30:
        raise ValueError("ids must be below 2**30")
    if not 0 < block <= BLOCK:
        raise ValueError(f"block must be 1 to {BLOCK}")
    known, ranks, counts = _ranked(ids)
    about = np.rint(4 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
    listed = zlib.compress(np.diff(known, prepend=np.uint32(0)).astype("<u4").tobytes() + about.tobytes(), 9)
    lanes, ways = -(-len(ids) // block), ways_for(block)
    head = MAGIC + struct.pack("<IIIQII", lanes, block, len(known), len(ids), len(listed), ways) + listed
    if not lanes:
        return head
    sums = [zlib.crc32(ids[i : i + block]) for i in range(0, len(ids), block)]
    counts, parts = [], []
    width = _lanes(len(known))
    for i in range(0, lanes, width):
        table = _table(ranks[i * block : (i + width) * block], block, ways)
        count, words = _encode_lanes(table, len(known), _ABOUT[about], ways)
        counts.append(count)
        parts.append(words.tobytes())
    index = np.array(sums, dtype="<u4").tobytes() + np.concatenate(counts).astype("<u2").tobytes()
    return head + index + b"".join(parts)


def _lanes(size: int) -> int:
    """Blocks at a time: as many as keep the model of that many distinct ids within memory."""
    return max(1, min(LANES, (1 << 27) // (8 * size + (4 << _SLOTS) + ((2 if size <= 1 << 16 else 4) << _places(size)))))


def decode(data: bytes) -> np.ndarray:
    """The ids that ``encode`` was given; ValueError if a block's checksum fails."""
    return decode_range(data, 0, 1 << 62)


def decode_range(data: bytes, start: int, stop: int) -> np.ndarray:
    """The ids from ``start`` to ``stop``, as far as there are any, from the blocks that hold them alone."""
    if data[:4] != MAGIC:
        raise ValueError("not a token block")
    lanes, block, size, n_ids, listed, ways = struct.unpack_from("<IIIQII", data, 4)
    start, stop = max(0, start), min(stop, n_ids)
    if start >= stop:
        return np.zeros(0, dtype=np.uint32)
    at = 32
    head = zlib.decompress(data[at : at + listed])
    known = np.cumsum(np.frombuffer(head, "<u4", size), dtype=np.uint32)
    about = _ABOUT[np.frombuffer(head, np.uint8, size, 4 * size)]
    at += listed
    sums = np.frombuffer(data, "<u4", lanes, at)
    counts = np.frombuffer(data, "<u2", ways * lanes, at + 4 * lanes).reshape(lanes, ways).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(counts.sum(axis=1))])
    words = np.frombuffer(data, _word(size)[2], int(begins[-1]), at + (4 + 2 * ways) * lanes)
    out, width, first, last = [], _lanes(size), start // block, -(-stop // block)
    i = first
    while i < last:
        j = min(last, i - i % width + width)  # of those that were coded in lockstep
        n = min(block, n_ids - (i - i % width) * block)
        table = _decode_lanes(words[begins[i] : begins[j]], counts[i:j].ravel(), -(-n // ways), size, about, ways)
        ranks = np.ascontiguousarray(table.T).reshape(j - i, -1)[:, :n]
        out.append(ranks.ravel()[: n_ids - i * block])
        i = j
    ids = known[np.concatenate(out)].astype("<u4")
    for i in range(first, last):
        if zlib.crc32(ids[block * (i - first) : block * (i - first + 1)]) != sums[i]:
            raise ValueError(f"block {i} is damaged")
    return ids[start - first * block : stop - first * block]
