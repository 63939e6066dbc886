"""Language identification with error-correcting output codes.

Every language has a codeword; for each bit of the code a binary classifier
over hashed character n-grams is fitted (log odds of the n-grams of the
languages whose bit is set against the others').  A text's codeword is decoded
by loss: each bit's margin is charged with its exponential loss, weighted by
how well that bit's classifier does on the training texts, and the nearest
codeword wins.  A text whose two best codewords are about equally near, or
whose signs differ from the winner's in more bits than the code corrects, is
flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.blocks import carried, carried_fields, carried_column
from millrace.llm.scratch import materialize, named, session, tidied

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 14
#: Texts are fitted on about so many documents a language; the sample's size doesn't grow with the table.
SAMPLE_PER_LANGUAGE = 1500
#: Labels whose shares are broadcast to the texts, at most; more are joined by shuffle.
BROADCAST_LABELS = 1 << 16
UNDETERMINED = "und"
#: Below this score the two best codewords are about equally near.
AMBIGUOUS_BELOW = 0.55
_CHUNK = 1 << 18
#: Weights, or losses, that are looked at together, and slices of the buckets whose weights are made together.
_CELLS, _SLICES = 1 << 22, 64


def _codes(data: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the n-gram at each byte, and whether it lies within its text."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    code = np.full(n, order, dtype=np.uint32)
    for i in range(order):
        code = (code ^ data[i : i + n]) * np.uint32(0x01000193) if i else (code * np.uint32(257)) ^ data[:n]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    code ^= code >> np.uint32(12)
    inside = np.ones(n, dtype=bool)
    for i in range(1, order):
        ends = starts[1:] - i
        inside[ends[(ends >= 0) & (ends < n)]] = False
    return (code & np.uint32(BUCKETS - 1)).astype(np.int64), inside


def _pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts as (index of the first, bytes, start of each and the end): about _CHUNK bytes each, or one text."""
    lower = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    offsets = np.frombuffer(lower.buffers()[1], dtype=np.int64)[lower.offset : lower.offset + len(lower) + 1]
    raw = lower.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(lower):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1)
        j = min(j, len(lower))
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _sums(weights: np.ndarray, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its n-grams' weights, and their number."""
    total = np.zeros((len(starts) - 1, weights.shape[2]))
    count = np.zeros(len(starts) - 1, dtype=np.int64)
    for at, order in enumerate(ORDERS):
        span = min(_CHUNK, max(64, _CELLS // weights.shape[2]))
        for lo in range(0, len(data), span):  # a very long text is taken in overlapping chunks
            part = data[lo : lo + span + order - 1]
            code, inside = _codes(part, starts - lo, order)
            if not len(code):
                continue
            first = np.clip(starts[:-1] - lo, 0, len(code))
            last = np.clip(starts[1:] - lo, 0, len(code))
            rows = np.flatnonzero(last > first)
            picked = np.where(inside[:, None], weights[at][code], np.float32(0))
            total[rows] += np.add.reduceat(picked, first[rows], axis=0, dtype=np.float64)
            count[rows] += np.add.reduceat(inside, first[rows], dtype=np.int64)
    return total, count


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1: the exhaustive code up to 7 languages, else the best of seeded random codes."""
    if n <= 7:
        m = max(n, 3)
        bits = [[(c >> i) & 1 for c in range(1, 1 << (m - 1))] for i in range(m - 1)]
        return np.array([[0] * len(bits[0]), *bits])[:n] * 2 - 1
    rng, best, width = np.random.default_rng(seed), None, int(np.ceil(10 * np.log2(n)))
    for _ in range(max(1, min(50, (1 << 26) // n**2))):
        code = rng.integers(0, 2, (n, width)) * 2 - 1
        least = least_apart(code)
        if best is None or least > best[0]:
            best = (least, code)
    return best[1]


def least_apart(code: np.ndarray) -> int:
    """The fewest bits in which two codewords differ, a block of them at a time; one alone differs from none."""
    n, width = code.shape
    signs, least = code.astype(np.float32), width
    for i in range(0, n, 1024):
        apart = (width - signs[i : i + 1024] @ signs.T) / 2
        apart[np.arange(len(apart)), np.arange(i, i + len(apart))] = width
        least = min(least, int(apart.min()))
    return least


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  #: languages x bits, +1 or -1
    weights: np.ndarray  #: orders x buckets x bits
    bit_weight: np.ndarray  #: by bit, 0 to 1
    ambiguous_below: float = AMBIGUOUS_BELOW

    def scores(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins (texts x bits) -> index of the nearest codeword, its probability-like score, bits that differ."""
        best, score = np.zeros(len(margin), dtype=np.int64), np.zeros(len(margin))
        on = (self.code > 0).astype(np.float64).T
        step = max(1, _CELLS // len(self.code))
        for i in range(0, len(margin), step):  # so many texts that their losses fit in memory, for any number of languages
            m = np.clip(margin[i : i + step], -8, 8)
            loss = (np.exp(-m) * self.bit_weight) @ on + (np.exp(m) * self.bit_weight) @ (1 - on)
            loss /= self.bit_weight.sum()
            best[i : i + step] = loss.argmin(axis=1)
            likely = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
            score[i : i + step] = 1 / likely.sum(axis=1)
        wrong = (np.sign(margin) * self.code[best] < 0).sum(axis=1)
        return best, score, wrong

    def margins(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), self.code.shape[1]))
        for i, data, starts in _pieces(texts):
            total, count = _sums(self.weights, data, starts)
            out[i : i + len(total)] = total / np.maximum(count, 1)[:, None] * 6
        return out


def fit(docs: DataFrame, text_col: str, lang_col: str, key: Column, per_language: int = SAMPLE_PER_LANGUAGE):
    """A LanguageModel of every label, from labelled rows: those whose key's hash falls below the share that leaves per_language.

    The labels are counted without the texts; the texts are read once, and the
    drawn ones kept in a table.  Each label's n-grams are counted in one task, from
    its sample alone; the weights of a slice of the buckets are made in one task from all labels' counts
    there.  To the driver come the labels, four sums each, and the weights: orders x BUCKETS
    numbers for each bit, whose number grows with the logarithm of that of the labels.
    Null texts and labels are left out; without any labelled text there is no model.
    """
    spark = session(docs)
    labelled = docs.where(named(lang_col).isNotNull()).select(named(lang_col).alias("lang"), named(text_col).alias("text"), F.xxhash64(key).alias("draw"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    shares = spark.createDataFrame([(lang, min(1.0, per_language / n)) for lang, n in sizes.items()], "lang string, share double")
    shares = F.broadcast(shares) if len(sizes) <= BROADCAST_LABELS else shares.hint("merge")
    draw = F.pmod("draw", F.lit(1_000_003)) / 1_000_003.0
    drawn = labelled.where("text IS NOT NULL").join(shares, "lang").where(draw < F.col("share"))
    sample = materialize(drawn.select("text", "lang"), "labelled")
    by_label = sample.repartition("lang").sortWithinPartitions("lang")
    wide = len(ORDERS) * BUCKETS // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, np.zeros((len(ORDERS), BUCKETS), dtype=np.int64)

        def counted() -> pa.RecordBatch:
            sums, rows = table.sum(axis=1), []
            for i, part in enumerate(table.reshape(_SLICES, wide)):
                at = np.flatnonzero(part)
                rows.append((now, i, at.astype(np.uint16).tobytes(), part[at].tobytes(), sums.tolist()))
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "slice", "places", "counts", "sums"])

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j and langs[i] != now:
                    if now is not None:
                        yield counted()
                    now, table[:] = langs[i], 0
                for _, data, starts in _pieces(batch.column(0).slice(i, j - i)):
                    for at, order in enumerate(ORDERS):
                        code, inside = _codes(data, starts, order)
                        table[at] += np.bincount(code[inside], minlength=BUCKETS)
        if now is not None:
            yield counted()

    schema = "lang string, slice int, places binary, counts binary, sums array<bigint>"
    cells = materialize(by_label.mapInArrow(tidied(count), schema), "grams")
    languages = sorted(sizes)  # of those without a text in the sample nothing is known but their number
    total = np.zeros((len(languages), len(ORDERS)))
    index = {lang: i for i, lang in enumerate(languages)}
    for r in cells.where("slice = 0").select("lang", "sums").toLocalIterator():
        total[index[r["lang"]]] = r["sums"]
    if not total.any():
        return None
    total += 0.5 * BUCKETS  # every language weighs the same
    code = codewords(len(languages))
    on = (code > 0).T.astype(np.float64)
    both = on.any(axis=1) & (1 - on).any(axis=1)
    shared = spark.sparkContext.broadcast((index, total, on, both))

    def weigh(table: pa.Table) -> pa.Table:
        index, total, on, both = shared.value
        slice_, part = table.column("slice")[0].as_py(), np.full((len(index), wide), 0.5)
        for row in table.select(["lang", "places", "counts"]).to_pylist():
            part[index[row["lang"]], np.frombuffer(row["places"], np.uint16)] += np.frombuffer(row["counts"], np.int64)
        part /= total[:, slice_ * wide // BUCKETS, None]
        out = np.zeros((len(on), wide), dtype=np.float32)
        n = on.sum(axis=1, keepdims=True)
        out[both] = np.log((on @ part)[both] / n[both]) - np.log(((1 - on) @ part)[both] / (len(index) - n[both]))
        return pa.table({"slice": pa.array([slice_], pa.int32()), "weights": pa.array([out.tobytes()], pa.binary())})

    weights = np.zeros((len(code[0]), _SLICES, wide), dtype=np.float32)
    for r in cells.select("slice", "lang", "places", "counts").groupBy("slice").applyInArrow(weigh, "slice int, weights binary").toLocalIterator():
        weights[:, r["slice"]] = np.frombuffer(r["weights"], np.float32).reshape(-1, wide)
    weights = np.ascontiguousarray(weights.reshape(-1, len(ORDERS), BUCKETS).transpose(1, 2, 0))
    model = LanguageModel(languages, code, weights, np.ones(code.shape[1]))
    fitted = spark.sparkContext.broadcast((model, index))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, index = fitted.value
        for batch in batches:
            truth = model.code[[index[x] for x in batch.column(1).to_pylist()]]
            right = (np.sign(model.margins(batch.column(0))) == truth).sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(right))), pa.array(right), pa.array([batch.num_rows] * len(right))],
                names=["bit", "right", "n"],
            )

    rated = sample.mapInArrow(tidied(rate), "bit bigint, right bigint, n bigint").groupBy("bit")
    for r in rated.agg((F.sum("right") / F.sum("n")).alias("rate")).collect():
        model.bit_weight[r["bit"]] = max(r["rate"] - 0.5, 0.01) * 2
    return model


def identify(
    docs: DataFrame,
    model: LanguageModel | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, text) -> (doc_id, lang_pred, score, ambiguous, bits_off, c0...), one row per input row.

    lang_pred is a learned language, or `und` with score 0 for a text that is null
    or has no letter (or if nothing could be learned).  Equal losses go to the
    first language by name.  Repeated rows come back repeated; columns named in
    ``carry`` come back as c0, c1..., others are ignored; an empty table gives an
    empty result.  One pass over whole texts, no shuffle; the model has a fixed size.
    """
    fields = carried_fields(docs, carry)
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("ambiguous", T.BooleanType()),
            T.StructField("bits_off", T.IntegerType()),
            *fields,
        ]
    )
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = carried(docs, id_col, text_col, carry).withColumns({"letters": letters})
    extra = [carried_column(i, carry, text_col) for i in range(len(fields))]
    if model is None:
        out = rows.withColumns({f.name: F.col(c) for f, c in zip(fields, extra, strict=True)})
        out = out.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
        return out.withColumns({"ambiguous": F.lit(True), "bits_off": F.lit(0)}).select(*schema.names)
    shared = session(docs).sparkContext.broadcast(model)
    corrects = (least_apart(model.code) - 1) // 2 if len(model.languages) > 1 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            best, score, wrong = m.scores(m.margins(batch.column(1)))
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.where(letters, best, len(names) - 1), np.where(letters, score, 0.0)
            unsure = (score < m.ambiguous_below) | (wrong > corrects)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(names[best], pa.string()),
                    pa.array(score),
                    pa.array(unsure),
                    pa.array(wrong.astype(np.int32)),
                    *[batch.column(c) for c in extra],
                ],
                names=schema.names,
            )

    return rows.mapInArrow(tidied(run), schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows outside the held-out fold: those whose crc32(id as text) mod 4 is not 2."""
    return docs.where(~held_out(named(id_col)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))
