"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most two bits apart share a variant at most one bit from
each.  Every distinct fingerprint therefore emits itself and its 64 one-bit
variants; fingerprints that meet at a variant are candidate links, verified by
their bit distance.  A variant can be met by 65 fingerprints at most, so no
group of the shuffle is large, whatever the data.  All fingerprints at one
variant are within two bits of each other: linking each to the smallest of
them keeps every component without emitting all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.scratch import materialize, named, session, tidied

SEED = 42


def simhash(text: str | None, words: int = 3) -> int:
    """The fingerprint of a whole text, unsigned."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(w) <= words:
        hashes = [digest(join(w), SEED)]
    else:
        hashes = [digest(join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)]
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = np.array(hashes[i : i + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, text) -> (doc_id, fp long): one row per input row; a null text counts as empty."""

    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((simhash(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, fp long")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by variant and fingerprint -> a link from each fingerprint to the first at its variant."""
    variant, first = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        v, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.empty(len(v), dtype=bool)
        new[0] = variant is None or v[0] != variant
        new[1:] = v[1:] != v[:-1]
        at = np.maximum.accumulate(np.where(new, np.arange(len(v)), -1))
        head = np.where(at >= 0, fp[at], first if first is not None else 0)
        variant, first = v[-1], head[-1]
        apart = np.bitwise_count((fp ^ head).view(np.uint64))
        keep = (apart > 0) & (apart <= 2)
        yield pa.RecordBatch.from_arrays([pa.array(fp[keep]), pa.array(head[keep])], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect all within two bits of each other."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    variants = fps.select("fp", F.explode(flips).alias("flip"))
    met = variants.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "fp")
    return met.repartition("variant").sortWithinPartitions("variant", "fp").mapInArrow(tidied(_stars), "a long, b long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3
) -> DataFrame:
    """(id, text) -> (doc_id, fp long, component_id long), one row per input row.

    component_id is the smallest id reachable by links of two bits or fewer, the
    row's own included.  Null and empty texts have fingerprint zero and link like
    any other; a null id takes part in linking but never names a component, so a
    component of null ids alone has a null component_id.  Repeated rows come back
    repeated; an empty table gives an empty result; extra columns are ignored.  A very
    long text is hashed whole by one task.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, words), "simhash")
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    stars = connected_components(links(groups.select("fp")))
    rooted = groups.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    smallest = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    of = materialize(rooted.join(smallest, "component").select("fp", "component_id"), "simhash-groups")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")
