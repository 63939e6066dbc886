"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding by the token-byte table.

Every block of documents explodes its texts into pre-tokens with positions.
Each distinct pre-token of a block is sent once, packed by its hash, to the
range that holds it; there each distinct word of the whole table is encoded
once, and its ids go back to the blocks that sent it, which put the documents
together again by position.  A word that fills a third of the table reaches its
range once a block.  Rows of a range are read one after another, and its words
are kept up to a fixed number, so the size of a range bounds no task's memory.
Decoding joins ids with the table of their tokens' bytes, of the vocabulary's
fixed size, as columns.
"""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import blocks as B
from millrace.llm.scratch import delete, materialize, named, session, shuffle_partitions, tidied, write

#: Larger than elsewhere: the larger a block, the less often a word is sent.
BLOCK_BYTES = 16 << 20
#: Words of a range that are remembered, at most; beyond, the memory starts anew and a word may be encoded again.
KNOWN = 1 << 20

_ZSTD, _UNZSTD = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
_RANKS: dict[str, dict[bytes, int]] = {}
_TOKENS: dict[str, pa.Array] = {}
_CORES: dict[str, tiktoken.Encoding] = {}


def ranks(path: str) -> dict[bytes, int]:
    """The rank of each token's bytes in a vocabulary file."""
    if path not in _RANKS:
        with open(path, "rb") as lines:
            _RANKS[path] = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return _RANKS[path]


def _core(path: str) -> tiktoken.Encoding:
    """The library for single words: whatever it is given is one match."""
    if path not in _CORES:
        _CORES[path] = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks(path), special_tokens={})
    return _CORES[path]


class _Numbers(dict):
    """A number for each word, by first use."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of all of them, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    parts = [_ZSTD.compress(p.tobytes()) for p in planes]
    return struct.pack("<5I", len(numbers), *map(len, parts)) + b"".join(parts)


def _numbers(data: bytes) -> np.ndarray:
    n, *sizes = struct.unpack_from("<5I", data)
    planes, at = np.empty((4, n), dtype=np.uint8), 20
    for plane, size in zip(planes, sizes, strict=True):
        plane[:] = np.frombuffer(_UNZSTD.decompress(data[at : at + size]), np.uint8)
        at += size
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _squeeze_small(numbers: np.ndarray) -> bytes:
    """Numbers most of which are below 255: a byte each, and the rest of the others, compressed."""
    low = np.minimum(numbers, 255).astype(np.uint8)
    return _framed([_ZSTD.compress(low.tobytes()), _squeeze(numbers[numbers >= 255] - 255)])


def _small_numbers(data: bytes) -> np.ndarray:
    low, rest = _unframed(data)
    numbers = np.frombuffer(_UNZSTD.decompress(low), np.uint8).astype(np.uint32)
    numbers[numbers == 255] += _numbers(rest)
    return numbers


def _framed(parts: list[bytes]) -> bytes:
    return struct.pack(f"<I{len(parts)}Q", len(parts), *map(len, parts)) + b"".join(parts)


def _unframed(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", data)
    ends = np.cumsum([4 + 8 * n, *struct.unpack_from(f"<{n}Q", data, 4)]).tolist()
    return [data[i:j] for i, j in zip(ends, ends[1:], strict=False)]


def _exploded(table: pa.Table, find, buckets: int) -> tuple[bytes, list[tuple[int, int, bytes]]]:
    """(ids, counts, each word's bucket and the word numbers by position, packed; the words of each bucket, packed).

    Words are numbered by first use, so that a first use needs no number: it is coded as 0, others as 1 more.
    """
    numbers, parts, counts = _Numbers(), [np.zeros(0, np.uint32)], []
    for text in table.column("text").combine_chunks():
        words = find(text.as_py() or "")
        counts.append(len(words))
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
    words = [w.encode() for w in numbers]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    rows = []
    for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if j > i:
            own = [words[k] for k in order[i:j].tolist()]
            sizes = np.fromiter(map(len, own), np.uint32, len(own))
            rows.append((b, j - i, _framed([_squeeze(sizes), _ZSTD.compress(b"".join(own))])))
    at = np.concatenate(parts)
    top = np.maximum.accumulate(np.concatenate([[-1], at.astype(np.int64)]))[:-1]
    coded = np.where(at > top, 0, at + np.uint32(1))
    docs = B.pack(pa.table({"doc_id": table.column("doc_id").combine_chunks(), "count": pa.array(counts, pa.int64())}))
    return _framed([docs, _squeeze(bucket), _squeeze_small(coded)]), rows


def _words(payload: bytes) -> list[bytes]:
    sizes, words = _unframed(payload)
    words, ends = _UNZSTD.decompress(words), np.cumsum(_numbers(sizes)).tolist()
    return [words[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def encode(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
    schema: str = "doc_id long, ids array<int>",
) -> DataFrame:
    """(id, text) -> (doc_id, ids array<int>), one row per input row.

    ids are the ranks of the tokens in the file ``vocabulary``; each match of
    ``pattern`` is encoded by itself, and no string is a special token.  Null and
    empty texts have no ids.  Repeated rows come back repeated; extra columns are
    ignored; an empty table gives an empty result.  A very long text is a block by itself,
    held whole by one task.  ``then`` is applied to each batch where it is made, and gives one of
    ``schema``: what is derived from the ids then needs no second worker.
    """
    spark = session(docs)
    buckets = shuffle_partitions(spark)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, find = B.block_ids(), regex.compile(pattern).findall
        for table in B.slices(batches, BLOCK_BYTES, 1):
            block = next(ids)
            payload, rows = _exploded(table, find, buckets)
            rows = [(block, 0, b, n, words) for b, n, words in rows] + [(block, B.LAST, 0, 0, payload)]
            yield _rows(rows)

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    path = write(rows.mapInArrow(tidied(explode), B.ANSWERS), "exploded", "none", by="level")
    # both folders may be missing: an empty table writes none, and texts without a word only blocks
    stored = spark.read.schema(B.ANSWERS).option("basePath", path).parquet(path)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, now, known = _core(vocabulary).encode_ordinary, None, {}
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for i in range(batch.num_rows):
                block, bucket, n, payload = (columns[c][i].as_py() for c in ("block", "bucket", "n", "payload"))
                if bucket != now or len(known) > KNOWN:
                    now, known = bucket, {}
                words = _words(payload)
                for w in words:
                    if w not in known:
                        known[w] = encoded(w.decode())
                found = [known[w] for w in words]
                sizes = np.fromiter(map(len, found), np.uint32, len(found))
                flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))
                yield _rows([(block, 0, bucket, n, _framed([_squeeze(sizes), _squeeze(flat)]))])

    asked = stored.where(F.col("level") == 0).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    answers = materialize(asked.mapInArrow(tidied(once), B.ANSWERS), "encoded", "none")
    delete(spark, f"{path}/level=0")
    blocks = stored.where(F.col("level") == B.LAST).select("block", "payload")

    def join(block: int, payload: bytes, given: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        docs, bucket, coded = _unframed(payload)
        table, coded = B.unpack(docs), _small_numbers(coded).astype(np.int64)
        at = np.where(coded == 0, np.cumsum(coded == 0) - 1, coded - 1)
        got = [_unframed(r["payload"]) for r in (given[0] if given else [])]
        flat = np.concatenate([*(_numbers(x[1]) for x in got), np.zeros(0, np.uint32)])
        order = np.argsort(_numbers(bucket), kind="stable")
        by_bucket = np.concatenate([*(_numbers(x[0]) for x in got), np.zeros(0, np.uint32)]).astype(np.int64)
        if len(by_bucket) != len(order):
            raise RuntimeError(f"{len(by_bucket)} answers to {len(order)} words")
        size, start = np.empty_like(by_bucket), np.empty_like(by_bucket)
        size[order], start[order] = by_bucket, np.cumsum(by_bucket) - by_bucket
        ends = np.concatenate([[0], np.cumsum(table.column("count").to_numpy())])
        ids = table.column("doc_id").combine_chunks()
        i = 0
        while i < table.num_rows:  # about half a million words at a time
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + (1 << 19), "right")) - 1)
            words = at[ends[i] : ends[j]]
            n = size[words]
            upto = np.concatenate([[0], np.cumsum(n)])
            tokens = flat[np.repeat(start[words] - upto[:-1], n) + np.arange(upto[-1])]
            offsets = pa.array(upto[ends[i : j + 1] - ends[i]].astype(np.int32))
            of_doc = pa.ListArray.from_arrays(offsets, pa.array(tokens.astype(np.int32)))
            batch = pa.RecordBatch.from_arrays([ids.slice(i, j - i), of_doc], names=["doc_id", "ids"])
            yield then(batch) if then else batch
            i = j

    return B.by_block(blocks, answers, join, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["block", "level", "bucket", "n", "payload"])


def tokens(vocabulary: str) -> pa.Array:
    """The bytes of each token, by id; null for an id that the vocabulary lacks."""
    if vocabulary not in _TOKENS:
        known = ranks(vocabulary)
        table: list[bytes | None] = [None] * (max(known.values(), default=-1) + 1)
        for token, rank in known.items():
            table[rank] = token
        _TOKENS[vocabulary] = pa.array(table, pa.binary())
    return _TOKENS[vocabulary]


def joined(ids: pa.ListArray, table: pa.Array, between: str | bytes) -> pa.Array:
    """Each row's ids joined with the table by id, and put together; null for null, KeyError for an id that it lacks."""
    flat = ids.flatten()
    if len(flat) and (flat.null_count or pc.min(flat).as_py() < 0 or pc.max(flat).as_py() >= len(table)):
        raise KeyError("an id that the vocabulary lacks")
    found = table.take(flat)
    if found.null_count:
        raise KeyError("an id that the vocabulary lacks")
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    out = pc.binary_join(pa.ListArray.from_arrays(offsets, found), between)
    return pc.if_else(ids.is_valid(), out, pa.scalar(None, out.type)) if ids.null_count else out


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids) -> (doc_id, ids, decoded binary), one row per input row; null ids decode to null, none to nothing.

    An id that the vocabulary lacks is an error.  Repeated rows come back repeated,
    extra columns are ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens(vocabulary)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                columns = [part.column(0), part.column(1), joined(part.column(1), table, b"")]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    rows = encoded.select(named(id_col).cast("long").alias("doc_id"), named(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(tidied(run), "doc_id long, ids array<int>, decoded binary")
