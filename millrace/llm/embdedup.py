"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative a group.

Copies of a vector are collapsed first.  Distinct vectors go to the cell of
their nearest centroid, and are compared within it.  So that no link is lost
at a border, a vector also visits each earlier cell that its links could reach:
two unit vectors with a cosine of t or more are no further apart than
sqrt(2 - 2t), so a member of another cell can only be that near if the vector
lies within this distance of the plane between the two centroids.  Where more
cells are needed than a sample of bounded size has centroids for, cells are cut
again by the residuals, in the same way, as often as that saves more comparisons than
it costs in copies.

A cell's residents are cut into blocks that stay; all who probe the cell pass by
each block once.  Products are in double precision.  A block gives the number of
links of each vector and links enough to connect them, not the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.embeddings import bounded_sample, in_blocks, matrix, unit, valid
from millrace.llm.scratch import materialize, named, session, shuffle_partitions, tidied

THRESHOLD = 0.93
#: Vectors that k-means is fitted on, at most.
SAMPLE = 20_000
#: Vectors of one label in a cell, as aimed for; and cells of one level, at most (the levels are as many as are needed).
CELL, CELLS = 4096, 256
#: Residents of a block, as aimed for, and vectors that probe one copy of it: beyond, its residents are copied.
BLOCK, PROBES = 8192, 65_536
#: Seconds that sending a copy of a vector takes, about, and comparing it by one component: what a level of cells must save.
SENT, COMPARED = 5e-6, 2.5e-10
#: Numbers that the places of a slice of vectors hold, about.
PLACED = 1 << 22


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """k centroids of unit length or fewer, for rows of unit length."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    if not k:
        return x[:0]
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], centres)
    return np.unique(centres, axis=0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 12) -> np.ndarray:
    """k centroids or fewer of rows x, by distance."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _apart(x, centres).argmin(axis=1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, but for a number by row."""
    return (centres * centres).sum(axis=1) - 2 * (x @ centres.T)


def levels(x: np.ndarray, need: int) -> list[np.ndarray]:
    """Centroids of unit rows, and of what is left of them at each further level, for ``need`` cells in all."""
    out: list[np.ndarray] = []
    while need > 1:
        k = min(CELLS, need, len(x) // 8)
        centres = kmeans(x, k) if out else spherical_kmeans(x, k)
        if len(centres) < 2:
            break
        out.append(centres)
        x, need = x - centres[_apart(x, centres).argmin(axis=1)], -(-need // len(centres))
    return out


def places(x: np.ndarray, cut: list[np.ndarray], reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, guest) of every place of unit rows; guest has a bit for each level at which it is a visit.

    Two rows within ``reach`` of each other share just one cell in which, at each level, one of them is at home.
    """
    row, cell, guest = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for level, centres in enumerate(cut):
        apart = _apart(x, centres)
        own = apart.argmin(axis=1)
        between = np.sqrt(np.maximum(0, ((centres[:, None] - centres) ** 2).sum(axis=2)))
        beyond = apart - apart[np.arange(len(own)), own][:, None]
        visit = (beyond <= 2 * reach * between[own] + 1e-9) & (np.arange(len(centres)) < own[:, None])
        from_, there = np.nonzero(visit)
        if level + 1 < len(cut):
            x = np.concatenate([x - centres[own], x[from_] - centres[there]])
        row = np.concatenate([row, row[from_]])
        cell = np.concatenate([cell * len(centres) + own, cell[from_] * len(centres) + there])
        guest = np.concatenate([guest, guest[from_] | 1 << level])
    return row, cell, guest


def worthwhile(x: np.ndarray, cut: list[np.ndarray], rows: int, reach: float) -> tuple[list[np.ndarray], float]:
    """The levels of ``cut`` down to which cells save more comparisons than their copies cost, and copies of a vector then.

    Estimated for ``rows`` vectors like those of the sample x.  Where vectors don't
    cluster, a further level soon sends every vector nearly everywhere.
    """
    some = x[:: max(1, len(x) // 256)]
    best, copies, cost, cells = 0, 1.0, rows * x.shape[1] * COMPARED if len(x) else 0.0, 1
    for level in range(1, len(cut) + 1):
        cells *= len(cut[level - 1])
        found = sum(len(places(some[i : i + 16], cut[:level], reach)[0]) for i in range(0, len(some), 16)) / len(some)
        now = found * (SENT + rows / cells * x.shape[1] * COMPARED)
        if now >= cost:
            break
        best, copies, cost = level, found, now
    return cut[:best], copies


class _Block:
    """A block's residents, what they are linked to so far, and which of them are connected."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).select(["gid", "vec", "copies", "guest"]).sort_by("gid").combine_chunks()
        self.gid, self.copies, self.guest = (table.column(c).to_numpy() for c in ("gid", "copies", "guest"))
        self.x = unit(matrix(table.column("vec").combine_chunks()))
        self.links = np.zeros(len(self.gid), dtype=np.int64)
        self.part = np.arange(len(self.gid))

    def probe(self, batch: pa.RecordBatch, threshold: float, last: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(gid, links, other) of those who pass by: a row for each with a link, and links that connect them."""
        gid, copies, guest = (batch.column(c).to_numpy() for c in ("gid", "copies", "guest"))
        x = unit(matrix(batch.column("vec")))
        for lo in range(0, len(x), 256):
            part = slice(lo, lo + 256)
            near = x[part] @ self.x.T >= threshold
            both = np.flatnonzero(guest[part])
            if len(both) and self.guest.any():  # not where both are visits at one level
                near[both] &= (guest[part][both][:, None] & self.guest) == 0
            at = np.minimum(np.searchsorted(self.gid, gid[part]), len(self.gid) - 1)
            itself = np.flatnonzero(self.gid[at] == gid[part])
            near[itself, at[itself]] = False
            visits = (guest[part] & last) > 0  # a resident that probes counts for itself
            self.links += copies[part][visits] @ near[visits]
            rows = np.flatnonzero(near.any(axis=1))
            found, other = [], []
            for r in rows.tolist():
                linked = np.flatnonzero(near[r])
                parts, first = np.unique(self.part[linked], return_index=True)
                found += [gid[lo + r]] * len(parts)
                other.append(self.gid[linked[first]])
                if len(parts) > 1:
                    self.part[np.isin(self.part, parts)] = parts[0]
            if len(rows):
                yield gid[part][rows], near[rows] @ self.copies, np.full(len(rows), -1)
                yield np.array(found), np.zeros(len(found), np.int64), np.concatenate(other)


def embedding_links(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str | None = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, vector, label) -> (vec_id, n_links, component_id, kept), one row per input row.

    Vectors link if their labels are equal and not null and their cosine, in
    double precision, is at least ``threshold``; without a label column, all may.
    Vectors that are null, zero, of another length, or hold null or non-finite
    components link with nothing.  n_links counts the other vectors linked
    directly, equal ones included; component_id is the smallest id reachable by
    links.  Repeated rows are vectors of their own: they link with each other.  A
    null id takes part but names no component (component_id is null and kept is
    true if there is no other).  Other columns are ignored, whatever their names;
    an empty table gives an empty result.

    A vector is known by a digest of 128 bits of its components, which is all that
    the tables of copies are joined by.
    """
    spark = session(vectors)
    label = named(label_col).cast("string") if label_col else F.lit("")
    vec = named(vec_col)
    if vectors.select(vec.alias("v")).schema["v"].dataType.simpleString() not in ("array<float>", "array<double>"):
        vec = vec.cast("array<double>")
    kind = vectors.select(vec.alias("v")).schema["v"].dataType.simpleString()
    rows = vectors.select(named(id_col).cast("long").alias("vec_id"), label.alias("label"), vec.alias("vec"))
    joins = valid(F.col("vec")) & F.col("label").isNotNull()
    rows = rows.select("vec_id", "label", F.when(joins, F.col("vec")).alias("vec"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, found = batch.column("vec"), []
            raw = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).view(np.uint8)
            width = raw.nbytes // max(1, len(lists.values))
            ends = lists.offsets.to_numpy().astype(np.int64) * width
            for i, there in enumerate(lists.is_valid().to_pylist()):
                found.append(hashlib.blake2b(raw[ends[i] : ends[i + 1]], digest_size=16).digest() if there else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=["vec_id", "label", "vec", "digest"])

    rows = materialize(rows.mapInArrow(tidied(digest), f"vec_id long, label string, vec {kind}, digest binary"), "vectors")
    some = rows.where("digest IS NOT NULL").groupBy("label", "digest")
    some = some.agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vec").alias("vec"))
    group = materialize(some.withColumn("gid", F.monotonically_increasing_id()), "distinct")
    largest = group.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    sample = bounded_sample(group, SAMPLE)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    cut, copies = worthwhile(unit(sample), levels(unit(sample), -(-largest // CELL)), largest, reach) if len(sample) else ([], 1.0)
    shared = spark.sparkContext.broadcast(cut)
    size, last = sample.shape[1], 1 << max(0, len(cut) - 1)
    step = max(16, min(1024, int(PLACED // (copies * max(1, size)))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            lists = batch.column(2)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            odd, usual = np.flatnonzero(lengths != size), np.flatnonzero(lengths == size)
            at, cell, guest = [odd], [-lengths[odd].astype(np.int64)], [np.zeros(len(odd), np.int64)]  # cells of their own
            if len(usual):
                row, *found = places(unit(matrix(lists.take(pa.array(usual)))), shared.value, reach)
                at, cell, guest = [odd, usual[row]], [*cell, found[0]], [*guest, found[1]]
            index = pa.array(np.concatenate(at))
            columns = [*(batch.column(i).take(index) for i in range(4)), *(pa.array(np.concatenate(x)) for x in (cell, guest))]
            yield pa.RecordBatch.from_arrays(columns, names=["gid", "label", "vec", "copies", "cell", "guest"])

    schema = f"gid long, label string, vec {kind}, copies long, cell long, guest long"
    placed = materialize(group.select("gid", "label", "vec", "copies").mapInArrow(tidied(assign), schema), "cells")
    home = F.col("guest").bitwiseAND(F.lit(last)) == 0
    sizes = placed.groupBy("label", "cell").agg(
        F.ceil(F.sum(home.cast("int")) / BLOCK).cast("int").alias("across"), F.ceil(F.count("*") / PROBES).cast("int").alias("down")
    )
    sized = placed.join(sizes.where("across > 0"), ["label", "cell"])
    spread, block = F.pmod(F.hash("gid"), F.lit(1 << 30)), F.struct("label", "cell", "i", "j").alias("block")
    probes = sized.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("across") - 1)), "j": F.pmod(spread, F.col("down"))})
    residents = sized.where(home).withColumns(
        {"i": F.pmod(spread, F.col("across")), "j": F.explode(F.sequence(F.lit(0), F.col("down") - 1))}
    )
    columns = ["gid", "vec", "copies", "guest"]
    both = residents.select(block, F.lit(False).alias("asks"), *columns).union(probes.select(block, F.lit(True), *columns))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(gid: np.ndarray, links: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
            other = pa.array(other, pa.int64(), mask=other < 0)
            return pa.RecordBatch.from_arrays([pa.array(gid, pa.int64()), pa.array(links, pa.int64()), other], names=["gid", "links", "other"])

        before = None
        for block, batch in in_blocks(batches, _Block):
            if before is not None and before is not block:
                yield out(before.gid, before.links, np.full(len(before.gid), -1))
            before = block
            for found in block.probe(batch, threshold, last):
                yield out(*found)
        if before is not None:
            yield out(before.gid, before.links, np.full(len(before.gid), -1))

    both = both.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block", "asks")
    met = materialize(both.mapInArrow(tidied(compare), "gid long, links long, other long"), "links")
    links = met.groupBy("gid").agg(F.sum("links").alias("links"))
    stars = connected_components(met.where("other IS NOT NULL").select(F.col("gid").alias("a"), F.col("other").alias("b")))
    known = group.select("gid", "label", "digest", "copies", "least")
    known = known.join(stars.withColumnRenamed("node", "gid"), "gid", "left").join(links, "gid", "left")
    known = known.withColumn("component", F.coalesce("component", "gid"))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "component").select(
        "label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = rows.where("digest IS NOT NULL").select("vec_id", "label", "digest")
    linked = linked.join(known, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("digest IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
