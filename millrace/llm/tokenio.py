"""Token-id files: whole documents' ids in ascending order of their document, range-coded in checksummed blocks.

A token file is a folder of Parquet parts, so any store that Spark writes can
hold it.  Each row is a chunk of whole documents: shard and chunk (their order
is that of the documents), n_ids, the index (document ids and counts) and the
coded blocks of ``rangecoder``, each of which is reset and checked by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import blocks as B
from millrace.llm import rangecoder
from millrace.llm.scratch import named, session, shuffle_partitions, tidied
from millrace.llm.tokens import encoder

#: Ids in a chunk, about; a longer document is a chunk by itself.
CHUNK = 1 << 23
END = 0


def write_token_file(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END
) -> None:
    """Write (id, text) as a token file: each text's ids, then ``end``.

    Documents go in ascending order of id, null ids last; rows that share an id
    follow one another in the order of their texts' hashes, in one or more parts.  Null texts count as
    empty; an empty table gives a file without chunks; other columns are ignored.  Documents are dealt by ranges of id, so parts are even whatever the
    sources, and no task holds more than one chunk.
    """
    n = shuffle_partitions(session(docs))
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    by_id = F.col("doc_id").asc_nulls_last()
    order = by_id, F.xxhash64("text")  # null and repeated ids are dealt by their texts
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tail = np.array([end], dtype="<u4").tobytes()
    names = ["shard", "chunk", "n_ids", "docs", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunk = TaskContext.get().partitionId(), 0
        docs, ids, held = [], [], 0
        own = encoder(tokenizer, wider=1)

        def full() -> pa.RecordBatch:
            index = pa.table({"doc_id": pa.array(docs, pa.int64()), "n": pa.array([len(x) // 4 for x in ids], pa.int64())})
            whole = np.frombuffer(b"".join(ids), "<u4")
            ids.clear()
            coded = rangecoder.encode(whole, rangecoder.block_for(len(whole)))
            row = (shard, chunk, held, B.pack(index), coded)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            for doc, found in zip(batch.column(0).to_pylist(), own.encode(texts), strict=True):
                if docs and held + len(found) // 4 + 1 > CHUNK:
                    yield full()
                    chunk, docs, ids, held = chunk + 1, [], [], 0
                docs.append(doc)
                ids.append(found + tail)
                held += len(found) // 4 + 1
        if docs:
            yield full()

    chunks = ordered.mapInArrow(tidied(run, encodes=True), "shard int, chunk int, n_ids long, docs binary, blocks binary")
    chunks.write.option("compression", "none").mode("overwrite").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(shard, chunk, doc_id, place, start, ids) of every document of a token file.

    start counts the ids before it in its chunk; ids are little-endian unsigned
    32-bit numbers.  A damaged block is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, index = rangecoder.decode(row["blocks"]), B.unpack(row["docs"])
                if len(ids) != row["n_ids"]:
                    raise ValueError(f"chunk {row['chunk']} of shard {row['shard']} is damaged")
                n = index.column("n").to_numpy()
                start = np.cumsum(n) - n
                raw = ids.astype("<u4").tobytes()
                parts = [raw[4 * i : 4 * (i + k)] for i, k in zip(start.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(n), pa.int32()),
                        pa.array([row["chunk"]] * len(n), pa.int32()),
                        index.column("doc_id").combine_chunks(),
                        pa.array(start),
                        pa.array(parts, pa.binary()),
                    ],
                    names=["shard", "chunk", "doc_id", "start", "ids"],
                )

    table = spark.read.parquet(path)
    return table.mapInArrow(tidied(run), "shard int, chunk int, doc_id long, start long, ids binary")


def chunk_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, chunk, before): the ids of a token file before each chunk, from its index columns alone."""
    chunks = spark.read.parquet(path).select("shard", "chunk", "n_ids")
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each part of the file
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("inside", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    return chunks.join(shards, "shard").select("shard", "chunk", (F.col("ahead") + F.col("inside")).alias("before"))


def with_starts(spark: SparkSession, path: str, chunks: DataFrame) -> DataFrame:
    """``read_chunks`` or a projection of it with shard, chunk and start -> start as counted over the whole file."""
    joined = chunks.join(chunk_starts(spark, path), ["shard", "chunk"])
    return joined.withColumn("start", F.col("start") + F.col("before")).drop("shard", "chunk", "before")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document of a token file; start counts the ids of all documents before it."""
    return with_starts(spark, path, read_chunks(spark, path))


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids) of the ids of a token file from ``start`` to ``stop``, as counted over the whole file, a row for each chunk.

    Only the blocks that hold them are decoded, and only they are checked.  Past the file's end there is nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = rangecoder.decode_range(row["blocks"], start - row["before"], stop - row["before"])
                columns = [pa.array([max(start, row["before"])]), pa.array([ids.astype("<u4").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["start", "ids"])

    chunks = spark.read.parquet(path).select("shard", "chunk", "n_ids", "blocks").join(chunk_starts(spark, path), ["shard", "chunk"])
    held = (F.col("before") < stop) & (F.col("before") + F.col("n_ids") > start)
    return chunks.where(held).select("before", "blocks").mapInArrow(tidied(run), "start long, ids binary")
