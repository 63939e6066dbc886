"""Quality rules as a short-circuit cascade.

A rule rejects a text or lets it pass, and a text is kept if every rule lets it
pass, so the order of the rules changes the work and never the result.  On a
sample each rule's cost (seconds a text) and its rejections are measured.  The
rules are then ordered greedily: the next one is that which rejects most per
second of the sample's texts that all rules before it let pass.  A text meets
the rules in this order until one rejects it; what later rules alone would need
is never computed for it.

Rules compare whole numbers, so they decide alike everywhere.  Words are runs of
bytes but ASCII white space; lines are cut at line feeds.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.blocks import carried, carried_column, carried_fields
from millrace.llm.scratch import session, tidied

#: Texts in the sample that costs and rejections are measured on, about; they only choose the order.
SAMPLE_ROWS = 2000
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\v\f\r"
#: Letters, and all bytes beyond ASCII, of which letters are made; the rest but white space is deleted.
_LETTERLESS = bytes(b for b in range(128) if not chr(b).isalpha() and b not in _SPACES)
_BULLETS = ("-", "*", "•")
_ELLIPSES = ("...", "…")


class _Numbers(dict):
    """A number for each word, by first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Text:
    """What rules look at, each part computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [x for x in self.text.split("\n") if x.strip(" \t\v\f\r")]

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words."""
        return len(self.text) - len(self.raw) + len(self.raw.translate(None, _SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        """Lines with a word that are equal to an earlier line."""
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def dup_line_chars(self) -> int:
        return sum(map(len, self.lines)) - sum(map(len, set(self.lines)))

    @cached_property
    def n_letter_words(self) -> int:
        return len(self.raw.translate(None, _LETTERLESS).split())

    @cached_property
    def numbers(self) -> tuple[np.ndarray, int]:
        """A number for each word, equal for equal words, and how many there are."""
        of = _Numbers()
        return np.fromiter(map(of.__getitem__, self.words), np.int64, self.n_words), len(of)

    @cached_property
    def word_bytes(self) -> np.ndarray:
        """The bytes of all words before each word, and of all."""
        return np.cumsum([0, *map(len, self.words)])

    def grams(self, n: int) -> np.ndarray:
        """A number for the window of ``n`` words at each word, equal for equal windows only."""
        ids, distinct = self.numbers
        found, size = ids, distinct
        for i in range(1, n):
            if size * distinct >= 1 << 63:  # numbers of fewer bits, so that the product stays exact
                found, size = np.unique(found, return_inverse=True)[1], len(ids)
            found = found[: len(ids) - i] * distinct + ids[i:]
            size *= distinct
        return found

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three words that are found twice or more in the text, the first one included."""
        if self.n_words < 4:
            return 0
        key = self.grams(3)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        covered = np.zeros(self.n_words, dtype=bool)
        for at in (order[1:][same], order[:-1][same]):
            for i in range(3):
                covered[at + i] = True
        return int(covered.sum())

    def top_gram_bytes(self, n: int) -> int:
        """The most bytes that occurrences of one window of ``n`` words have together, of those found three times or more."""
        if self.n_words < n + 2:
            return 0
        _, first, count = np.unique(self.grams(n), return_index=True, return_counts=True)
        often = count > 2
        first, count = first[often], count[often]
        return int(((self.word_bytes[first + n] - self.word_bytes[first]) * count).max(initial=0))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _share(part: Callable[[Text], int], whole: Callable[[Text], int], percent: int) -> Callable[[Text], bool]:
    return lambda t: 100 * part(t) > percent * whole(t)


#: What is rejected whatever the other rules say.
BASE = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_words", _share(lambda t: t.n_repeat_words, lambda t: t.n_words, 50)),
)
#: The limits in common use for web text, as percentages.
RULES = (
    Rule("short_words", lambda t: t.word_chars < 3 * t.n_words),
    Rule("long_words", lambda t: t.word_chars > 10 * t.n_words),
    Rule("symbols", _share(lambda t: t.n_symbols, lambda t: t.n_words, 10)),
    Rule("repeated_lines", _share(lambda t: t.dup_line_chars, lambda t: len(t.text), 20)),
    Rule("words_without_letter", _share(lambda t: t.n_words - t.n_letter_words, lambda t: t.n_words, 20)),
    Rule("bullet_lines", _share(lambda t: sum(x.lstrip(" \t\v\f\r").startswith(_BULLETS) for x in t.lines), lambda t: len(t.lines), 90)),
    Rule("ellipsis_lines", _share(lambda t: sum(x.rstrip(" \t\v\f\r").endswith(_ELLIPSES) for x in t.lines), lambda t: len(t.lines), 30)),
    Rule("top_2_words", _share(lambda t: t.top_gram_bytes(2), lambda t: int(t.word_bytes[-1]), 20)),
    Rule("top_3_words", _share(lambda t: t.top_gram_bytes(3), lambda t: int(t.word_bytes[-1]), 18)),
    Rule("top_4_words", _share(lambda t: t.top_gram_bytes(4), lambda t: int(t.word_bytes[-1]), 16)),
)
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Measured:
    """Seconds of each rule over the sample, and how many texts each set of rules (as bits) rejects."""

    seconds: dict[str, float]
    rejected: dict[int, int]


def measure(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    base: tuple[Rule, ...] = BASE,
    reported: tuple[str, ...] = REPORTED,
    text_col: str = "text",
    rows: int = SAMPLE_ROWS,
) -> Measured:
    """Cost and rejections of each rule over about ``rows`` texts that ``base`` lets pass, drawn from all of ``docs``.

    What is reported is computed for every text anyway, so rules that need nothing
    else cost next to nothing.  Only sums reach the driver: at most one number for
    each text of the sample.
    """
    n = docs.count()
    drawn = carried(docs.withColumn("doc_id", F.lit(0)), "doc_id", text_col, ()).select("text")
    drawn = drawn.sample(min(1.0, rows / n), seed=1) if n else drawn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, found = [0] * len(rules), {}
        for batch in batches:
            for text in batch.column(0):
                known = Text(text.as_py())
                for name in reported:
                    getattr(known, name)
                if any(r.rejects(known) for r in base):
                    continue
                bits = 0
                for i, rule in enumerate(rules):
                    own = Text(known.text)  # a rule pays for all that isn't reported
                    own.__dict__ |= known.__dict__
                    began = time.perf_counter_ns()
                    bits |= rule.rejects(own) << i
                    spent[i] += time.perf_counter_ns() - began
                found[bits] = found.get(bits, 0) + 1
        rows = [(-1 - i, x) for i, x in enumerate(spent)] + list(found.items())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 2, names=["what", "n"])

    session(docs)
    sums = drawn.mapInArrow(tidied(run), "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()
    of = {r["what"]: r["n"] for r in sums}
    seconds = {rule.name: of.get(-1 - i, 0) / 1e9 for i, rule in enumerate(rules)}
    return Measured(seconds, {k: v for k, v in of.items() if k >= 0})


def ordered(rules: tuple[Rule, ...], measured: Measured) -> tuple[Rule, ...]:
    """The rules by rejections per second among what those before let pass; those that reject nothing, by cost."""
    left, order, alive = list(range(len(rules))), [], dict(measured.rejected)
    while left:
        def worth(i: int) -> tuple[float, float]:
            cost = max(measured.seconds.get(rules[i].name, 0.0), 1e-9)
            return sum(n for bits, n in alive.items() if bits >> i & 1) / cost, -cost

        best = max(left, key=worth)
        left.remove(best)
        order.append(rules[best])
        alive = {bits: n for bits, n in alive.items() if not bits >> best & 1}
    return tuple(order)


def cascade(
    docs: DataFrame,
    rules: tuple[Rule, ...] | None = None,
    base: tuple[Rule, ...] = BASE,
    reported: tuple[str, ...] = REPORTED,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, text) -> (doc_id, one column for each of ``reported``, base_failed, kept, rejected_by, c0...), a row for each row.

    ``rules`` are taken in their order; without them, RULES in the order that a
    sample of ``docs`` gives.  rejected_by names the rule that ended the cascade, null
    for a text that is kept; of a text that several rules reject, which one is met
    first depends on the order, all else doesn't.

    A null text counts as empty, and so has too few words.  Repeated rows and ids are
    judged one by one, a null id stays null, columns named in ``carry`` come back as
    c0, c1..., others are ignored, and an empty table gives an empty result.  A text
    is judged whole, in memory in proportion to its length (about 25 times); nothing is shuffled.
    """
    if rules is None:
        rules = ordered(RULES, measure(docs, RULES, base, reported, text_col))
    fields = carried_fields(docs, carry)
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType())]
        + [T.StructField(name, T.LongType()) for name in reported]
        + [T.StructField(name, T.BooleanType()) for name in ("base_failed", "kept")]
        + [T.StructField("rejected_by", T.StringType()), *fields]
    )
    extra = [carried_column(i, carry, text_col) for i in range(len(fields))]
    first = len(base)
    steps = (*base, *rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, at = [], []
            for value in batch.column(1):
                text = Text(value.as_py())
                numbers.append([getattr(text, name) for name in reported])
                at.append(next((i for i, rule in enumerate(steps) if rule.rejects(text)), len(steps)))
            columns = np.array(numbers, dtype=np.int64).reshape(len(at), len(reported))
            names = [*(r.name for r in steps), None]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(columns[:, i]) for i in range(len(reported))],
                    pa.array([i < first for i in at], pa.bool_()),
                    pa.array([i == len(steps) for i in at], pa.bool_()),
                    pa.array([names[i] for i in at], pa.string()),
                    *[batch.column(c) for c in extra],
                ],
                names=schema.names,
            )

    session(docs)
    return carried(docs, id_col, text_col, carry).mapInArrow(tidied(run), schema)
