"""Substring dedup by level-wise doubling.

Windows of words are judged at lengths that double up to the full one (9, 18
and 35 words for 35).  Only windows whose shorter windows repeat are extended to
the next length, until no candidates survive or the full length is reached; its
repeated windows are removed, every copy of them.

A full window need not be judged by all of its shorter windows: at each level
the one whose hash is least among them stands for the rest.  Equal full windows
choose the same one, so a window that repeats can't be lost, and the first
level sends one key for about fourteen words.  What repeats is found by the
exchange in ``blocks``.  At the shorter lengths its keys are plain 64-bit hashes,
where a collision only costs an extension.  At the full length, which decides,
they are 128 bits made of cryptographic digests of the words, under a key drawn
for the run: nobody can choose texts that collide.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm import blocks as B
from millrace.llm.scratch import materialize, session

WINDOW = 35
#: Shorter windows than this repeat too often by chance to be worth a pass.
SHORTEST = 9


def _words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Each text, the hashes of all words, and the number of each text's first word and the end."""
    raw = [t.as_py() or b"" for t in texts.cast(pa.binary())]
    return raw, *B.word_hashes(raw)


def _levels(window: int) -> list[int]:
    return [n for n in B.halves(window) if n >= SHORTEST or n == window]


def _starts(ends: np.ndarray, window: int) -> np.ndarray:
    """Whether a whole window within one document starts at each word."""
    ok = np.ones(max(0, int(ends[-1]) - window + 1), dtype=bool)
    for i in ends[1:-1].tolist():
        ok[max(0, i - window + 1) : i] = False
    return ok


def _full(raw: list[bytes], ends: np.ndarray, alive: np.ndarray, window: int, key: bytes) -> np.ndarray:
    """Two numbers for each whole window that is alive: sums of its words' digests times powers of odd numbers."""
    of, words, count = B.Digests(key, 16), [np.zeros(0, np.int64)], np.diff(ends)
    any_alive = np.concatenate([[0], np.cumsum(alive)])[np.minimum(ends, len(alive))]
    for i in np.flatnonzero(np.diff(any_alive)).tolist():
        words.append(of.numbers(raw[i]))
    lanes = of.lanes()[np.concatenate(words)] if len(of) else np.zeros((0, 2), np.uint64)
    here = np.repeat(np.diff(any_alive) > 0, count)  # the words of those texts
    at = (np.cumsum(here) - 1)[: len(alive)][alive]  # the first word of each window, among them
    out = np.empty((len(at), 2), dtype=np.uint64)
    for lane in range(2):
        odd = int.from_bytes(hashlib.blake2b(b"%d" % lane, digest_size=8, key=key).digest(), "little") | 5
        up = np.cumprod(np.full(len(lanes) + 1, odd, dtype=np.uint64))
        down = np.cumprod(np.full(len(lanes) + 1, pow(odd, -1, 1 << 64), dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lanes[:, lane] * up[:-1], dtype=np.uint64)])
        out[:, lane] = (sums[at + window] - sums[at]) * down[at]
    return out


def _climb(raw: list[bytes], hashes: np.ndarray, ends: np.ndarray, window: int, answers: list[list[dict]], key: bytes):
    """(keys, checks, multi) that the next level asks about, or after the last level which windows repeat."""
    alive, h, at = _starts(ends, window), hashes, 1
    levels = _levels(window)
    sizes = B.halves(window)
    for size in sizes:
        if size > 1:
            h, at = B.doubled(h, at, size), size
        if size not in levels:
            continue
        level = levels.index(size)
        if size == window:
            digests = _full(raw, ends, alive, window, key)
            order = np.lexsort((digests[:, 1], digests[:, 0]))
            new = np.any(digests[order[1:]] != digests[order[:-1]], axis=1)
            first = np.concatenate([[0], np.flatnonzero(new) + 1])[: len(order)]
            back = np.empty(len(order), dtype=np.int64)
            back[order] = np.concatenate([[0], np.cumsum(new)])[: len(order)]
            copies = np.diff(np.append(first, len(order)))
            keys, checks = (digests[order[first], lane] for lane in range(2))
        else:
            places = B.least_at(h, window - size + 1)[alive]
            new = np.ones(len(places), dtype=bool)
            new[1:] = places[1:] != places[:-1]  # one place may stand for many windows, one after another
            keys, back, copies = np.unique(B.spread(h[places[new]]), return_inverse=True, return_counts=True)
            back, checks = back[np.cumsum(new) - 1], None
        if level == len(answers) or not len(keys):
            return "ask", keys, checks if len(keys) else None, copies > 1
        found = B.bits(answers[level], len(keys))
        alive[np.flatnonzero(alive)[~found[back]]] = False
    return "done", alive, None, None


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    carry: tuple[str, ...] = (),
    keep_layout: bool = False,
) -> DataFrame:
    """(id, text) -> (doc_id, n_words, n_removed, spans, text, c0...), one row per input row.

    Words are runs of bytes other than ASCII white space.  Every word covered by a
    window of ``window`` words that also starts anywhere else, in the same
    document or another, is removed; windows are judged on the input.  spans are
    the removed runs, as word numbers [start, stop).  text is the kept words
    joined by one space, or with keep_layout the text as it was if nothing is
    removed.  Null texts have no words and give an empty text.  Repeated rows are
    documents of their own, so each is a copy of the other; documents shorter than
    the window lose nothing; an empty table gives an empty result.  A very long text is
    a block by itself, held whole by one task in each pass.  Columns named in
    ``carry`` come back as c0, c1..., whatever their names; others are ignored.
    """
    session(docs)
    store = B.write_blocks(docs, id_col, text_col, carry)
    buckets, key = B.ranges(store), secrets.token_bytes(32)
    answers = None

    def step(block: int, payload: bytes, given: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        raw, hashes, ends = _words(B.unpack(payload).column("text").combine_chunks())
        kind, keys, checks, multi = _climb(raw, hashes, ends, window, given, key)
        if kind == "ask":
            yield from B.ask(block, keys, checks, multi, buckets)

    for level in range(len(_levels(window))):
        found = materialize(B.repeated(B.by_block(store, answers, step, B.ASKS), level, buckets), f"repeated-{level}")
        answers = found if answers is None else answers.union(found)
        if found.isEmpty():
            break

    fields = B.carried_fields(docs, carry)
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("text", T.StringType()),
            *fields,
        ]
    )

    def finish(block: int, payload: bytes, given: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        table = B.unpack(payload)
        raw, hashes, ends = _words(table.column("text").combine_chunks())
        kind, alive, _, _ = _climb(raw, hashes, ends, window, given, key)
        edge = np.zeros(len(hashes) + 1, dtype=np.int64)
        if kind == "done":
            starts = np.flatnonzero(alive)
            edge[starts] += 1
            edge[starts + window] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = before[ends[1:]] - before[ends[:-1]]
        texts, spans = [], []
        old = table.column("text").to_pylist()
        for i, text in enumerate(raw):
            lost = gone[ends[i] : ends[i + 1]]
            if not removed[i]:
                spans.append([])
                texts.append((old[i] or "") if keep_layout else b" ".join(text.split()).decode())
                continue
            words = text.split()
            cuts = np.flatnonzero(np.diff(np.concatenate([[0], lost.view(np.int8), [0]])))
            spans.append(cuts.reshape(-1, 2).tolist())
            texts.append(b" ".join([words[j] for j in np.flatnonzero(~lost).tolist()]).decode())
        columns = [
            table.column("doc_id").combine_chunks(),
            pa.array(np.diff(ends).astype(np.int64)),
            pa.array(removed.astype(np.int64)),
            pa.array(spans, pa.list_(pa.list_(pa.int64()))),
            pa.array(texts, pa.string()),
            *[table.column(B.carried_column(i, carry, text_col)).combine_chunks() for i in range(len(fields))],
        ]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return B.by_block(store, answers, finish, schema)
