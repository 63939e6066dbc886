"""Vectors as numpy matrices, and which of them are valid; shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vec: Column) -> Column:
    """Whether a vector is there, holds only finite components and isn't zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """Lists of one length as a matrix, a row each."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the scale is taken out first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bounded_sample(rows: DataFrame, most: int, column: str = "vec") -> np.ndarray:
    """About ``most`` rows at most, drawn by the hash of the vector, as a matrix of the commonest length."""
    n = rows.count()
    share = min(1.0, most / max(n, 1))
    drawn = rows.where(F.pmod(F.xxhash64(column), F.lit(1_000_003)) < F.lit(share * 1_000_003)).select(column)
    got = drawn.limit(2 * most).toArrow().column(0).combine_chunks()
    lengths = got.value_lengths().to_numpy(zero_copy_only=False) if len(got) else np.zeros(0)
    if not len(lengths):
        return np.zeros((0, 0))
    size = int(np.bincount(lengths.astype(int)).argmax())
    return matrix(got.filter(pa.array(lengths == size)))


def in_blocks(batches: Iterator[pa.RecordBatch], opened: Callable[[list[pa.RecordBatch]], object]) -> Iterator[tuple]:
    """(block, batch of asking rows), from rows sorted by ``block`` and, within it, those that don't ask first.

    ``opened`` makes a block from its rows that don't ask, once it is asked; a block without them isn't asked.
    Only one block is held at a time, and the rows that ask pass by.
    """
    now, held, block = None, [], None
    for batch in batches:
        keys = batch.column("block").to_pylist()
        asks = batch.column("asks").to_pylist()
        cuts = [i for i in range(1, len(keys)) if asks[i] != asks[i - 1] or keys[i] != keys[i - 1]]
        for i, j in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if i == j:
                continue
            if keys[i] != now:
                now, held, block = keys[i], [], None
            if not asks[i]:
                held.append(batch.slice(i, j - i))
                continue
            if held:
                block, held = opened(held), []
            if block is not None:
                yield block, batch.slice(i, j - i)
