"""Ids of whole texts by the tokenizers library, with a bounded memory of pieces already encoded.

The byte-level pre-tokenizer always cuts right before a single space that a
non-space follows, and the cut depends on nothing to its left.  A text in which
every space is such a space, and that holds no added token, is therefore encoded piece by piece: the library
encodes each piece that isn't remembered, and the ids of all pieces are put
together by position.  Any other text goes to the library whole.

Pieces of up to 16 bytes are remembered by all of their bytes, in a table of fixed size in which a new
piece takes the place of an old one; longer ones in a bounded dictionary.  No hash decides an id.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
from tokenizers import Tokenizer

from millrace.llm.blocks import first_bytes, mix

#: Bits of the memory's index, the ids in it before it starts anew, and the pieces of over 16 bytes in it (of LONG at most).
SLOTS, KEPT, KEPT_LONG, LONG = 21, 1 << 22, 1 << 15, 256
#: Texts are encoded in runs of about so many bytes, and new pieces in runs of so many.
RUN, FRESH = 1 << 21, 512

_ASCII_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r\x1c\x1d\x1e\x1f", np.uint8))
#: The first two bytes of white space beyond ASCII, in UTF-8 (the third is not looked at).
_WIDE_SPACE = [0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380]


class Encoder:
    """Little-endian unsigned 32-bit ids of texts; the memory of pieces is doubled ``wider`` times."""

    def __init__(self, path: str, wider: int = 0):
        self.slots, self.kept, self.kept_long = SLOTS + wider, KEPT << wider, KEPT_LONG << wider
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # a text that holds the string of an added token, such as <|endoftext|>, goes to the library whole
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        # pieces hold for the byte-level pre-tokenizer without a prefix space and without a normalizer
        state = self.library.pre_tokenizer.__getstate__() if self.library.pre_tokenizer else b""
        self.pieces = (
            b'"ByteLevel"' in state and b'"add_prefix_space":false' in state and self.library.normalizer is None
        )
        # the byte-level vocabulary writes a space as U+0120: a token that begins with it begins a piece
        ids = self.library.get_vocab()
        self.begins = np.zeros(max(ids.values(), default=0) + 1, dtype=bool)
        self.begins[[i for token, i in ids.items() if token.startswith("\u0120")]] = True
        self._forget()

    def _forget(self) -> None:
        kinds = (np.uint64, np.uint64, np.uint8, np.int32, np.uint8)
        self.low, self.high, self.length, self.start, self.size = (np.zeros(1 << self.slots, dtype=kind) for kind in kinds)
        self.ids, self.held = np.zeros(self.kept + (self.kept >> 2), dtype=np.uint32), 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def release(self) -> None:
        """Forget all pieces and give their memory back."""
        self.low, self.high, self.length, self.start, self.size, self.ids = (np.zeros(0, dtype=np.uint8) for _ in range(6))
        self.long, self.held = {}, self.kept + 1

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, none of which is empty or holds a space, each after a space; and their numbers."""
        found, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(pieces), FRESH):
            part = pieces[i : i + FRESH]
            (ids,) = self._library([" " + " ".join(part)])
            cuts = np.flatnonzero(self.begins[ids])
            if len(cuts) == len(part):
                found.append(ids)
                sizes.append(np.diff(np.append(cuts, len(ids))))
            else:  # a token spans two pieces, or begins inside one
                lists = self._library([f" {p}" for p in part])
                found.extend(lists)
                sizes.append(np.array([len(x) for x in lists]))
        return np.concatenate(found), np.concatenate(sizes)

    def _appended(self, pool: np.ndarray, end: int, ids: np.ndarray) -> tuple[np.ndarray, int]:
        """The pool with ids put behind its first ``end``, in place if there is room; and the new end."""
        if end + len(ids) > len(pool):
            pool = np.concatenate([pool[:end], ids])
        else:
            pool[end : end + len(ids)] = ids
        return pool, end + len(ids)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text in order; null counts as empty."""
        run, held = [], 0
        for text in texts:
            run.append(text or "")
            held += len(run[-1])
            if held >= RUN:
                yield from self._run(run)
                run, held = [], 0
        if run:
            yield from self._run(run)

    def _run(self, texts: list[str]) -> list[bytes]:
        if not self.pieces:
            return [ids.astype("<u4").tobytes() for ids in self._library(texts)]
        raw = [t.encode() for t in texts]
        text = b" ".join([b"", *raw, b" " * 16])
        data = np.frombuffer(text, dtype=np.uint8)
        spaces = np.flatnonzero(data == 32)
        offsets = np.cumsum([1, *(len(t) + 1 for t in raw)])
        first = np.searchsorted(spaces, offsets) - 1  # each text's first piece, and the end
        starts, length = spaces[: first[-1]] + 1, np.diff(spaces[: first[-1] + 1]) - 1
        heads = np.zeros(len(starts), dtype=bool)
        heads[first[:-1]] = True
        # a piece that is empty or begins with white space follows a space that isn't cut before
        bad = _ASCII_SPACE.take(data[starts]) & ~heads
        wide = np.flatnonzero(data[starts] >= 0xC2)
        two = data[starts[wide]].astype(np.int64) << 8 | data[starts[wide] + 1]
        bad[wide] |= np.isin(two, _WIDE_SPACE) & ~heads[wide]
        whole = np.searchsorted(first, np.flatnonzero(bad), "right") - 1
        held = [i for a in self.added if a in text for i, t in enumerate(raw) if a in t]
        whole = np.unique(np.concatenate([whole, np.array(held, dtype=np.int64)]))
        skip = heads.copy()
        for i in whole.tolist():
            skip[first[i] : first[i + 1]] = True

        if self.held > self.kept or len(self.long) > self.kept_long:
            self._forget()
        # a piece of up to 16 bytes is all of (low, high, length)
        low, high = first_bytes(data, starts, length), first_bytes(data, starts + 8, np.maximum(length - 8, 0))
        short = length <= 16
        slot = (mix(low, high + length.astype(np.uint64)) >> np.uint64(64 - self.slots)).astype(np.int64)
        size = self.size.take(slot)
        known = short & (size > 0) & (self.low.take(slot) == low) & (self.high.take(slot) == high) & ~skip
        known &= self.length.take(slot) == length
        begin, size = np.where(known, self.start.take(slot), 0).astype(np.int64), np.where(known, size, 0).astype(np.int64)
        pool, end = self.ids, self.held  # ids from here on are this run's alone
        asked = np.flatnonzero(short & ~known & ~skip)
        asked = asked[np.lexsort((length[asked], high[asked], low[asked]))]
        same = (low[asked[1:]] == low[asked[:-1]]) & (high[asked[1:]] == high[asked[:-1]])
        same &= length[asked[1:]] == length[asked[:-1]]
        first_of = np.concatenate([[True], ~same])[: len(asked)]
        at, back = asked[first_of], np.cumsum(first_of) - 1
        long = np.flatnonzero(~short & ~skip)
        names = [text[i : i + n] for i, n in zip(starts[long].tolist(), length[long].tolist(), strict=True)]
        unknown = list(dict.fromkeys(n for n in names if n not in self.long))
        if len(at) or unknown:
            fresh = [text[i : i + n] for i, n in zip(starts[at].tolist(), length[at].tolist(), strict=True)] + unknown
            new, sizes = self._fresh([p.decode() for p in fresh])
            begins = np.cumsum(sizes) - sizes + end
            begin[asked], size[asked] = begins[back], sizes[back]
            pool, end = self._appended(pool, end, new)
            own, of = slot[at], slice(len(at))
            found = dict(zip(unknown, zip(begins[len(at) :].tolist(), sizes[len(at) :].tolist(), strict=True), strict=True))
            of_long = [self.long.get(n) or found[n] for n in names]
            if pool is self.ids:
                self.held = end
                self.low[own], self.high[own], self.length[own], self.start[own] = low[at], high[at], length[at], begins[of]
                self.size[own] = np.where(sizes[of] < 256, sizes[of], 0)  # a piece of more ids isn't remembered
                self.long |= {n: x for n, x in found.items() if len(n) <= LONG}
            else:  # a run of more new ids than there is room for
                self.held = self.kept + 1
        else:
            of_long = [self.long[n] for n in names]
        if len(long):
            begin[long], size[long] = np.array(of_long, dtype=np.int64).T
        # first pieces, and texts that go to the library whole, which stand at their first piece
        alone = set(whole.tolist())
        own = self._library([t if i in alone else t.partition(" ")[0] for i, t in enumerate(texts)])
        sizes = np.array([len(x) for x in own], dtype=np.int64)
        begin[first[:-1]], size[first[:-1]] = np.cumsum(sizes) - sizes + end, sizes
        pool, _ = self._appended(pool, end, np.concatenate(own))
        out, upto = [], np.concatenate([[0], np.cumsum(size)])
        i = 0
        while i < len(raw):  # about half a million pieces at a time
            j = max(i + 1, int(np.searchsorted(first, first[i] + (1 << 19), "right")) - 1)
            lo, hi = first[i], first[j]
            n = size[lo:hi]
            tokens = pool.take(np.repeat(begin[lo:hi] - upto[lo:hi], n) + np.arange(upto[lo], upto[hi]))
            flat, cuts = tokens.astype("<u4").tobytes(), ((upto[first[i : j + 1]] - upto[lo]) * 4).tolist()
            out.extend(flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
            i = j
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, wider: int = 0) -> Encoder:
    """The encoder of a vocabulary file, one for each worker and width of its memory."""
    if (path, wider) not in _ENCODERS:
        _ENCODERS[path, wider] = Encoder(path, wider)
    return _ENCODERS[path, wider]


def release() -> None:
    """Give back what this worker's encoders remember."""
    for own in _ENCODERS.values():
        own.release()
