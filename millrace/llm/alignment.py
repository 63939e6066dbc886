"""Two tokenizers' tokens of the same texts, aligned by the bytes that they cover.

Both tokenizers cut before a space that stands between two words, whatever is
around it.  So a text is a sequence of pieces, each a space and what follows it
up to the next such space, and tokens, groups and links of a text are those of
its pieces.  A block of documents aligns each of its distinct pieces once: DuckDB,
over the Arrow tables of the block, joins the intervals of the two tokenizers'
tokens.  An ASOF join gives the B token in which each A token starts, another,
bounded by the A token's range, the B tokens that start inside an A token; these
are all overlaps.  Window sums over the offsets at which both end number the
groups.

The pairs of ids linked in a block are counted there, each pair once, and merged
in Spark by groupBy.  The corpus-wide counts go back to the blocks that have the
pair, joined by its two ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from millrace.llm import blocks as B
from millrace.llm.scratch import give_back, materialize, named, session, tidied

#: Bytes of text in a block, about, and tokens that DuckDB gets at once, unless a piece alone has more.
BLOCK_BYTES, TOKENS = 5 << 20, 1 << 17
#: Pieces that are encoded at once, and of them so many as one text.
ENCODED, RUN = 1 << 14, 256
#: Bytes of groups in a batch of results, about.
BATCH_BYTES = 8 << 20
#: A space that is cut before: no space stands before it, and no white space behind it.
_CUT = re.compile(r"(?<=[^ ]) (?=\S)")
#: Where a text isn't cut at a space.
_UNCUT = re.compile(r" (?=\s|\Z)|\A ")
#: A piece that begins with white space, in pieces with a space before each.
_LEADS = re.compile(r" \s")
#: Ids of pieces, one behind the other, and how many each piece has.
_Ids = tuple[np.ndarray, np.ndarray]


def _byte_level() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Pair:
    """Both tokenizers, and the bytes of their tokens by id."""

    def __init__(self, a: str, b: str):
        self.a = Tokenizer.from_file(a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = SentencePieceProcessor(model_file=b)
        of = _byte_level()
        ids = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.tables = [pa.array(table, pa.binary()) for table in (self.a_bytes, self.b_bytes)]
        self.lengths = [np.array([len(x) for x in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes)]
        self.begins = [np.array([x.startswith(b" ") for x in table]) for table in (self.a_bytes, self.b_bytes)]
        self.numbers = pa.array([str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))])
        #: Whether tokens of B hold a space at their beginning only, so that pieces can be encoded alone.
        self.cuts = all(b" " not in x.lstrip(b" ") for x in self.b_bytes)

    def encode(self, pieces: list[str]) -> tuple[_Ids, _Ids]:
        """A's ids of a space and each piece, and B's of the piece, before which it puts a space itself."""
        one = lambda texts: [x.ids for x in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        other = lambda texts: self.b.encode(texts, num_threads=1)
        return _in_runs(pieces, one, self.begins[0]), _in_runs(pieces, other, self.begins[1])

    def fitting(self, pieces: list[str], sides: tuple[_Ids, _Ids]) -> np.ndarray:
        """Whether the tokens of either side give back the bytes of a piece, for each."""
        raw = [f" {p}".encode() for p in pieces]
        ends = np.cumsum([0, *map(len, raw)])
        whole, given = b"".join(raw), []
        for (flat, n), table, lengths in zip(sides, self.tables, self.lengths, strict=True):
            upto = np.concatenate([[0], np.cumsum(lengths[flat])])[np.concatenate([[0], np.cumsum(n)])]
            data = table.take(pa.array(flat)).buffers()[2]
            given.append((data.to_pybytes()[: upto[-1]] if data else b"", upto))
        # all at once: the same bytes in all, cut at the same places
        if all(data == whole and np.array_equal(upto, ends) for data, upto in given):
            return np.ones(len(pieces), dtype=bool)
        return np.array([all(data[upto[i] : upto[i + 1]] == x for data, upto in given) for i, x in enumerate(raw)])

    def split(self, texts: pa.Array) -> pa.ListArray:
        """The pieces of each text, without the space before them; null or none for a null or empty text."""
        odd = [i for i, t in enumerate(texts.to_pylist()) if t and (not self.cuts or _UNCUT.search(t))]
        apart = np.arange(len(texts))
        apart[odd] = len(texts) + np.arange(len(odd))
        rest = pc.if_else(pa.array(apart < len(texts)), texts, pa.scalar(None, texts.type))
        rest = pc.split_pattern(pc.if_else(pc.equal(rest, ""), pa.scalar(None, texts.type), rest), " ")
        own = [_CUT.split(t) if self.cuts else [t] for t in texts.take(pa.array(odd, pa.int64())).to_pylist()]
        return pa.concat_arrays([rest, pa.array(own, rest.type)]).take(pa.array(apart))


def _in_runs(pieces: list[str], encode: Callable[[list[str]], list[list[int]]], begins: np.ndarray) -> _Ids:
    """The ids of the pieces, of runs of pieces encoded as one text and cut at the tokens that begin with a space.

    A run whose pieces don't begin with just these tokens is encoded piece by piece.
    """
    runs = [pieces[i : i + RUN] for i in range(0, len(pieces), RUN)]
    texts = [" ".join(run) for run in runs]
    flat, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for run, text, ids in zip(runs, texts, encode(texts), strict=True):
        ids = np.array(ids, dtype=np.int64)
        cuts = np.flatnonzero(begins[ids])
        if len(cuts) == len(run) == text.count(" ") + 1 and not _LEADS.search(f" {text}"):
            flat.append(ids[cuts[0] :])
            n.append(np.diff(cuts, append=len(ids)))
        else:
            each = encode(run)
            n.append(np.fromiter(map(len, each), np.int64, len(each)))
            flat.append(np.fromiter(chain.from_iterable(each), np.int64, int(n[-1].sum())))
    return np.concatenate(flat), np.concatenate(n)


@cache
def _pair(a: str, b: str) -> _Pair:
    return _Pair(a, b)


#: All overlaps: the B token in which each A token starts, and the B tokens that start inside an A token.
_LINKS = """
SELECT a.unit, a.id AS a, b.id AS b FROM a ASOF JOIN b ON b.s <= a.s
UNION ALL
SELECT a.unit, a.id, b.id FROM b ASOF JOIN a ON a.s < b.s WHERE b.s < a.e"""


def _groups(own: str, other: str) -> str:
    """Each token's group, in order: the number of offsets before its end at which tokens of both end."""
    return f"""
SELECT CAST(coalesce(sum(CAST({other}.e IS NOT NULL AS INT)) OVER (
    ORDER BY {own}.s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g
FROM {own} LEFT JOIN {other} ON {own}.e = {other}.e ORDER BY {own}.s"""


def _offsets(sorted_keys: np.ndarray, n: int) -> pa.Array:
    """Where each of n keys begins, and the end."""
    return pa.array(np.searchsorted(sorted_keys, np.arange(n + 1)).astype(np.int32))


def _slice(units: np.ndarray, a: _Ids, b: _Ids, pair: _Pair, db: duckdb.DuckDBPyConnection) -> tuple[np.ndarray, pa.Table]:
    """Links (unit, a, b) and (n_a, n_b, n_groups, groups) of pieces, which lie one behind the other."""
    sides = []
    for name, (flat, n), lengths in (("a", a, pair.lengths[0]), ("b", b, pair.lengths[1])):
        end = np.cumsum(lengths[flat])
        own = np.repeat(np.arange(len(n)), n)
        db.register(name, pa.table({"unit": own, "id": flat, "s": end - lengths[flat], "e": end}))
        sides.append((n, flat, own))
    links = np.stack([c.to_numpy().astype(np.int32) for c in db.sql(_LINKS).to_arrow_table().columns])
    found = []
    for (_, flat, own), sql in zip(sides, (_groups("a", "b"), _groups("b", "a")), strict=True):
        group = db.sql(sql).to_arrow_table().column(0).to_numpy()
        of_unit = group[np.searchsorted(own, np.arange(len(units)))]
        ids = pa.ListArray.from_arrays(_offsets(group, int(group[-1]) + 1), pair.numbers.take(pa.array(flat)))
        found.append((of_unit, pc.binary_join(ids, ",")))
    db.unregister("a")
    db.unregister("b")
    (first, left), (_, right) = found
    each = pc.binary_join_element_wise(left, right, "|")
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(each)).astype(np.int32)), each), ";")
    links[0] = units[links[0]]
    counts = {"n_a": sides[0][0], "n_b": sides[1][0], "n_groups": np.diff(np.append(first, len(each)))}
    return links, pa.table({"unit": units, **counts, "groups": texts})


def _align(pieces: pa.Array, pair: _Pair, db: duckdb.DuckDBPyConnection) -> tuple[np.ndarray, pa.Table]:
    """Links (unit, a, b), and what is known of the pieces whose tokens give back their bytes, by unit, the piece's number."""
    links, found = [np.zeros((3, 0), dtype=np.int32)], []
    for at in range(0, len(pieces), ENCODED):
        some = pieces.slice(at, ENCODED).to_pylist()
        sides = pair.encode(some)
        fits = pair.fitting(some, sides)
        sides = [(flat[np.repeat(fits, n)], n[fits]) for flat, n in sides]
        units, ends = np.flatnonzero(fits) + at, [np.concatenate([[0], np.cumsum(n)]) for _, n in sides]
        upto, lo = ends[0] + ends[1], 0
        while lo < len(units):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + TOKENS, "right")) - 1)
            own = [(flat[end[lo] : end[hi]], n[lo:hi]) for (flat, n), end in zip(sides, ends, strict=True)]
            more, known = _slice(units[lo:hi], *own, pair, db)
            links.append(more)
            found.append(known)
            lo = hi
    none = {x: pa.array([], pa.int64()) for x in ("unit", "n_a", "n_b", "n_groups")} | {"groups": pa.array([], pa.string())}
    return np.concatenate(links, axis=1), pa.concat_tables(found).combine_chunks() if found else pa.table(none)


def _block(table: pa.Table, pair: _Pair, db: duckdb.DuckDBPyConnection) -> tuple[bytes, pa.Table]:
    """A block's documents, pieces and the places of their pairs, packed; and its pairs (a, b, n), by their places."""
    lists = pair.split(table.column("text").combine_chunks())
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    of = lists.flatten().dictionary_encode()
    units, of = of.indices.to_numpy(), of.dictionary
    (unit, a, b), pieces = _align(of, pair, db)
    fits = np.zeros(len(of), dtype=bool)
    fits[pieces.column("unit").to_numpy()] = True
    # a text with a piece that isn't given back has no tokens
    doc, whole = np.repeat(np.arange(len(n)), n), np.ones(len(n), dtype=bool)
    whole[doc[~fits[units]]] = False
    units, n = units[whole[doc]], np.where(whole, n, 0)
    times = np.bincount(units, minlength=len(of))
    # pieces are numbered anew, those that occur most first, so that the documents' numbers are small
    rank = np.empty(len(of), dtype=np.int32)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(of))
    used = np.flatnonzero(times[unit] > 0)  # not those of documents without tokens alone
    used = used[np.argsort(rank[unit[used]], kind="stable")]
    unit = unit[used]
    keys, place = np.unique(a[used].astype(np.int64) << 32 | b[used], return_inverse=True)
    counts = np.zeros(len(keys), dtype=np.int64)
    np.add.at(counts, place, times[unit])
    ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    rows = pa.table({"doc_id": table.column("doc_id"), "units": pa.ListArray.from_arrays(ends, pa.array(rank[units]))})
    known = pieces.column("unit").to_numpy()
    n_links = np.bincount(unit, minlength=len(of))[known]
    pieces = pieces.set_column(0, "unit", pa.array(rank[known])).append_column("n_links", pa.array(n_links))
    pieces = pieces.take(pa.array(np.argsort(rank[known], kind="stable")))
    places = pa.table({"place": place.astype(np.int32)})  # those of each piece, one behind the other
    return B.pack(rows) + B.pack(pieces) + B.pack(places), pa.table({"a": keys >> 32, "b": keys & 0xFFFFFFFF, "n": counts})


def _stored(docs: DataFrame, a: str, b: str, id_col: str, text_col: str) -> DataFrame:
    """(block, payload, a, b, n), a row for each block; the last three are arrays of its pairs of ids and their counts."""
    schema = "block long, payload binary, a array<int>, b array<int>, n array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = B.block_ids()
        with duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""}) as db:
            for table in B.slices(batches, BLOCK_BYTES, 1):
                payload, pairs = _block(table, _pair(a, b), db)
                lists = [pa.array([pairs.column(c).to_numpy()], pa.list_(kind)) for c, kind in (("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([next(ids)]), pa.array([payload], pa.binary()), *lists], names=["block", "payload", "a", "b", "n"])
                del payload, pairs, lists
                give_back()

    session(docs)
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return materialize(rows.mapInArrow(tidied(run), schema), "aligned", "zstd")


def _counted(stored: DataFrame) -> DataFrame:
    """(a, b, n, best): how many links hold each pair of ids, and whether no other pair with this b has more."""
    pairs = stored.select(F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select("x.a", "x.b", "x.n")
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    # a row for each id of B at most
    return counts.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n, best): each pair of ids of the tokenizers ``a`` and ``b`` that is linked in any text; see ``align``."""
    return _counted(_stored(docs, a, b, id_col, text_col))


def align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) -> (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), a row for each row.

    ``a`` is the file of a byte-level tokenizer of the tokenizers library, which gets
    a space and the text; ``b`` a model of sentencepiece that puts the space there
    itself.  Special tokens' strings are plain text.  Offsets at which tokens of both
    end cut the bytes into groups, `a1,a2|b1;a3|b2,b3` in ``groups``.  Links are the
    pairs of an A and a B token whose bytes overlap; a pair of ids counts as often as
    it is linked in all texts.  n_best: links whose count no other pair with their B id
    exceeds; count_sum: the counts of all links.

    Null and empty texts, and those whose tokens of A or B don't give back a space and
    the text, have no tokens: zeros and an empty string.  Repeated rows are texts of
    their own and count as such; null ids stay null, other columns are ignored; an
    empty table gives an empty result.  A very long text is a block by itself and is held
    there in memory; DuckDB gets 2**17 tokens at a time, or those of one longer piece without a
    space to cut at.
    """
    stored = _stored(docs, a, b, id_col, text_col)
    pairs = stored.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("place", "x"))
    told = pairs.select("block", "place", "x.a", "x.b").join(_counted(stored), ["a", "b"])
    # a row for each distinct pair of a block, of which there are as many as its text allows
    answer = F.sort_array(F.collect_list(F.struct("place", "n", "best")))
    told = told.groupBy("block").agg(answer.alias("x")).select("block", F.col("x.n").alias("counts"), F.col("x.best").alias("best"))
    both = stored.select("block", "payload").join(told, "block", "left").select("payload", "counts", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    names = schema.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                reader = pa.BufferReader(batch.column(0)[row].as_buffer())
                docs, pieces, places = (pa.ipc.open_stream(reader).read_all().combine_chunks() for _ in range(3))
                counts, best = ((x[row].values.to_numpy(zero_copy_only=False) if x[row].is_valid else np.zeros(0)) for x in batch.columns[1:])
                place, known = places.column(0).to_numpy(), pieces.column("unit").to_numpy()
                if len(place) and place.max() >= len(counts):
                    raise RuntimeError("pairs of a block are missing")
                unit = np.repeat(known, pieces.column("n_links").to_numpy())
                size = int(known.max(initial=-1)) + 1
                sums = np.zeros((6, size), dtype=np.int64)
                for i, name in enumerate(names[1:5]):
                    sums[i, known] = pieces.column(name).to_numpy()
                np.add.at(sums[4], unit, best[place].astype(np.int64))
                np.add.at(sums[5], unit, counts[place].astype(np.int64))
                texts = np.full(size, None)
                texts[known] = pieces.column("groups").to_pylist()
                out, held = [], 0
                for doc, units in zip(docs.column(0).to_pylist(), docs.column(1), strict=True):
                    own = units.values.to_numpy()
                    out.append((doc, *sums[:, own].sum(axis=1).tolist(), ";".join(texts[own])))
                    held += len(out[-1][-1])
                    if held >= BATCH_BYTES:
                        yield _rows(out, names)
                        out, held = [], 0
                if out:
                    yield _rows(out, names)

    return both.mapInArrow(tidied(run), schema)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
