"""Periodic runs of words, found on a harmonic grid.

A run is a stretch of words with smallest period q that is at least ``repeats``
periods and ``shortest`` words long and that no neighbouring word extends.  For
each period p a run of at least m = max(shortest, repeats * p) words has m - p
places or more at which a word equals that p words on.  So every run has such a
place on the grid of multiples of m - p, and the grids of all periods have
together about n log n points.

All pairs of a period and a grid point are laid out as numpy arrays and handled
at once, a bounded number at a time.  Pairs whose two words are equal are
extended to both sides: the longest common extension is found by binary search
over prefix hashes, in step for all pairs.  A hash can only make an extension
too long; so the words of each run found are compared themselves, and a pair
that fails is extended word by word.  The same run is found from several points
and at multiples of its period; the smallest period is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.blocks import carried, carried_column, carried_fields, spread
from millrace.llm.scratch import session, tidied

SHORTEST, REPEATS = 24, 3
#: Words of several short texts handled together, about, and pairs of a period and a grid point.
WORDS, PAIRS = 1 << 16, 1 << 19
#: The least extension on one side that is asked for at once, before the search.
PROBE = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """A number for each word, by first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Prefixes:
    """Whether two stretches of equal length hold the same words, by hashes; for any number of pairs at once."""

    def __init__(self, ids: np.ndarray):
        self.power = np.full(len(ids) + 1, _BASE)
        self.power[0] = 1
        self.power = np.cumprod(self.power)
        self.sums = np.zeros(len(ids) + 1, dtype=np.uint64)
        np.cumsum(spread(ids.astype(np.uint64)) * self.power[:-1], out=self.sums[1:])

    def equal(self, i: np.ndarray, p: np.ndarray, length: np.ndarray) -> np.ndarray:
        """ids[i : i + length] against the same p on."""
        near = self.sums[i + length] - self.sums[i]
        return near * self.power[p] == self.sums[i + p + length] - self.sums[i + p]

    def ahead(self, i: np.ndarray, p: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The longest common extension of i and i + p to the right, ``most`` at most."""
        return self._search(most, lambda rows, n: self.equal(i[rows], p[rows], n))

    def behind(self, i: np.ndarray, p: np.ndarray, most: np.ndarray) -> np.ndarray:
        """To the left, without the words at i and i + p."""
        return self._search(most, lambda rows, n: self.equal(i[rows] - n, p[rows], n))

    @staticmethod
    def _search(most: np.ndarray, equal: Callable) -> np.ndarray:
        low, high = np.zeros(len(most), dtype=np.int64), most.copy()
        while len(rows := np.flatnonzero(low < high)):
            n = (low[rows] + high[rows] + 1) >> 1
            same = equal(rows, n)
            low[rows[same]] = n[same]
            high[rows[~same]] = n[~same] - 1
        return low


def _exact(ids: np.ndarray, i: int, p: int, first: int, end: int) -> tuple[int, int]:
    """The stretch around i with period p, word by word."""
    ahead = ids[i : end - p] != ids[i + p : end]
    behind = (ids[first:i] != ids[first + p : i + p])[::-1]
    f = int(ahead.argmax()) if ahead.any() else len(ahead)
    b = int(behind.argmax()) if behind.any() else len(behind)
    return i - b, i + p + f


def _holds(ids: np.ndarray, s: int, e: int, p: int, first: int, end: int) -> bool:
    """Whether the words from s to e have period p, and neither neighbour extends them."""
    if not np.array_equal(ids[s : e - p], ids[s + p : e]):
        return False
    return (s == first or ids[s - 1] != ids[s - 1 + p]) and (e == end or ids[e] != ids[e - p])


def find(ids: np.ndarray, ends: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS, prefixes=_Prefixes) -> np.ndarray:
    """Rows (start, length, period), by start, then period, of all runs in texts that lie one behind the other.

    ids: a number for each word, equal for equal words only; ends: the first word of each text, and the end.
    """
    size = np.diff(ends)
    periods = size // repeats * (size >= shortest)  # of each text, from 1
    text = np.repeat(np.arange(len(size)), periods)
    if not len(text):
        return np.zeros((0, 3), dtype=np.int64)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(shortest, repeats * period) - period
    count = (size[text] - period - 1) // step + 1
    total, hashes = np.cumsum(count), None
    found: list[np.ndarray] = []
    lo = 0
    while lo < len(text):
        done = int(total[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        n = count[lo:hi]
        row = np.repeat(np.arange(lo, hi), n)
        k = np.arange(len(row)) - np.repeat(total[lo:hi] - n - done, n)
        i, p = ends[text[row]] + k * step[row], period[row]
        hit = np.flatnonzero(ids[i] == ids[i + p])
        lo = hi
        if not len(hit):
            continue
        hashes = hashes or prefixes(ids)
        i, p, row = i[hit], p[hit], row[hit]
        first, end = ends[text[row]], ends[text[row] + 1]
        # of a stretch of 2 * PROBE places around i, one half lies on one side of it
        probe = np.minimum(PROBE, step[row] // 2)
        right, left = i + p + probe <= end, i - probe >= first
        right[right] = hashes.equal(i[right], p[right], probe[right])
        left[left] = hashes.equal((i - probe)[left], p[left], probe[left])
        keep = np.flatnonzero(right | left)
        i, p, row, first, end = (x[keep] for x in (i, p, row, first, end))
        e = i + p + hashes.ahead(i, p, end - i - p)
        s = i - hashes.behind(i, p, i - first)
        long = e - s >= step[row] + p
        found.append(np.stack([s, e, p, i, first, end], axis=1)[long])
    return _distinct(ids, np.concatenate(found), shortest, repeats) if found else np.zeros((0, 3), dtype=np.int64)


def _distinct(ids: np.ndarray, found: np.ndarray, shortest: int, repeats: int) -> np.ndarray:
    """The runs of rows (start, end, period, a place in it, first and end of its text), each once, with words compared."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    runs: dict[tuple[int, int], int] = {}
    again = []
    cut = np.flatnonzero(np.any(found[1:, :2] != found[:-1, :2], axis=1)) + 1
    for rows in np.split(found, cut) if len(found) else []:
        left = rows
        while len(left):  # once, unless a hash was wrong
            s, e, p, i, first, end = left[0].tolist()
            if _holds(ids, s, e, p, first, end):
                runs[s, e] = min(p, runs.get((s, e), p))
                left = left[left[:, 2] % p != 0]  # multiples of a period are periods
            else:
                again.append((i, p, first, end))
                left = left[1:]
    for i, p, first, end in again:
        s, e = _exact(ids, i, p, first, end)
        if e - s >= max(shortest, repeats * p):
            runs[s, e] = min(p, runs.get((s, e), p))
    out = np.array([(s, e - s, p) for (s, e), p in runs.items()], dtype=np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _best(runs: list[list[int]]) -> list[int]:
    """The run with most periods; of equal ones that with the smallest start, then period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[list[int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return [w for w, out in zip(words, gone.tolist(), strict=True) if not out] if gone.any() else words


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shortest: int = SHORTEST,
    repeats: int = REPEATS,
    carry: tuple[str, ...] = (),
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(id, text) -> (doc_id, n_runs, start, length, period, exponent_milli, runs, text, c0...), a row for each row.

    start, length, period and exponent_milli (1000 * length / period, rounded down)
    are those of the run with most periods, of equal ones the first by start, then
    period; null without a run.  runs has all of them by start, then period; text is
    the text's words joined by one space, without those that a run holds after its
    first period.  Starts and lengths count words.  ``rewrite`` gets the id and the
    words of each text and gives those to look at.

    A null text counts as empty: no runs, an empty text.  A null id stays null,
    repeated rows are handled one by one, columns named in ``carry`` come back as c0,
    c1..., others are ignored; an empty table gives an empty result.  A text is handled
    whole in one task, in memory in proportion to its length (about 60 times) beside a
    bounded number of pairs, and time n log n; nothing is shuffled.
    """
    fields = carried_fields(docs, carry)
    longs = ("n_runs", "start", "length", "period", "exponent_milli")
    run_type = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), *[T.StructField(x, T.LongType()) for x in longs]]
        + [T.StructField("runs", T.ArrayType(run_type)), T.StructField("text", T.StringType())]
        + [T.StructField(f.name, f.dataType) for f in fields]
    )
    extra = [carried_column(i, carry, text_col) for i in range(len(fields))]
    arrow_run = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def together(texts: list[list[bytes]]) -> Iterator[tuple]:
        ends = np.cumsum([0, *map(len, texts)])
        of = _Numbers()
        ids = np.fromiter((x for words in texts for x in map(of.__getitem__, words)), np.int64, int(ends[-1]))
        found = find(ids, ends, shortest, repeats)
        at = np.searchsorted(found[:, 0], ends).tolist()
        for k, words in enumerate(texts):
            runs = [[s - int(ends[k]), n, p] for s, n, p in found[at[k] : at[k + 1]].tolist()]
            best = _best(runs) if runs else None
            numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            named_runs = [{"start": s, "length": n, "period": p} for s, n, p in runs]
            yield len(runs), *numbers, named_runs, b" ".join(collapsed(words, runs)).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, texts = [], 0, []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                texts.append(rewrite(doc, words) if rewrite else words)
                held += len(texts[-1])
                if held >= WORDS:
                    rows += together(texts)
                    held, texts = 0, []
            rows += together(texts)
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(c, pa.int64()) for c in columns[:5]],
                    pa.array(columns[5], arrow_run),
                    pa.array(columns[6], pa.string()),
                    *[batch.column(c) for c in extra],
                ],
                names=schema.names,
            )

    session(docs)
    return carried(docs, id_col, text_col, carry).mapInArrow(tidied(run), schema)


def listed(runs: Column) -> Column:
    """Runs as text: a line `start,length,period` for each."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))))
