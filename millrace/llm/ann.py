"""Approximate nearest neighbours by inner product, with score-aware (anisotropic) quantisation.

Vectors are quantised in small subspaces of 16 codewords, four bits each.  The
codebook is fitted for the error in scores that matters for the largest inner
products: the residual along the vector weighs more than that across it.  A
query's products with all codewords form a table; scanning the four-bit codes
sums its entries.  In each block of candidates the best are ranked again by exact
products of the original vectors, and then all others whose rough score could
reach the k-th of these, by the length of their residual.

Vectors lie in coarse cells.  A query visits the cells whose centres score within a
reach of its best one.  The reach is fitted so that nearly every query of the sample finds
nearly all of its own neighbours: a query in a cluster then visits few cells and
one between them many, in the same table.  A candidate goes to its block of its
cell and stays; queries go to the blocks that they visit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from millrace.llm.embdedup import spherical_kmeans
from millrace.llm.embeddings import bounded_sample, in_blocks, matrix, unit, valid
from millrace.llm.scratch import materialize, named, session, shuffle_partitions, tidied

#: Vectors that the codebook is fitted on, at most; every row is indexed.
SAMPLE = 10_000
SUBSPACE, CODEWORDS = 2, 16
#: The share of a vector's length from which products matter: the residual along it weighs accordingly.
SCORE_THRESHOLD = 0.2
#: Candidates of a block, from and to (a 64th of all, between), and those ranked again first in each block.
CANDIDATES, RERANKED = (16_384, 65_536), 256
#: Bytes of the vectors of a block in memory, at most, whatever their length.
BLOCK_BYTES = 64 << 20
#: Vectors of the sample for each cell, at least, and queries that visit one copy of a block: beyond, its candidates are copied.
OF_CELL, QUERIES = 32, 65_536
#: The share of its neighbours that the visited cells hold, and of the sample's queries for which they do.
FOUND, PROBED = 0.98, 0.99


@dataclass
class Codebook:
    words: np.ndarray  #: subspaces x 16 x SUBSPACE
    size: int  #: components of a vector
    along: float  #: weight of the parallel residual; that of the rest is 1

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into subspaces, padded with zeros."""
        pad = self.words.shape[0] * SUBSPACE - self.size
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SUBSPACE)

    def encode(self, x: np.ndarray, rounds: int = 3) -> np.ndarray:
        """The codeword in each subspace, by coordinate descent on the score-aware loss."""
        parts = self.parts(x)
        length = np.sqrt((x * x).sum(axis=1))
        toward = parts / np.maximum(length, 1e-300)[:, None, None]
        rows = np.arange(len(x))
        codes = np.zeros(parts.shape[:2], dtype=np.uint8)
        across, shift = [], []  # by subspace: squared residual and residual along the vector, for each codeword
        for m, words in enumerate(self.words):
            rest = parts[:, m, None, :] - words[None]
            across.append((rest * rest).sum(axis=2))
            shift.append((rest * toward[:, m, None, :]).sum(axis=2))
            codes[:, m] = across[-1].argmin(axis=1)
        total = sum(s[rows, codes[:, m]] for m, s in enumerate(shift))
        for _ in range(rounds):
            before = codes.copy()
            for m in range(len(self.words)):
                others = total - shift[m][rows, codes[:, m]]
                loss = across[m] + (self.along - 1) * (others[:, None] + shift[m]) ** 2
                codes[:, m] = loss.argmin(axis=1)
                total = others + shift[m][rows, codes[:, m]]
            if (codes == before).all():
                break
        return codes

    def errors(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far a rough score may be off for a query of length 1: the residual's length, and the rounding of tables."""
        near = self.words[np.arange(len(self.words)), codes]
        rest = np.sqrt(((self.parts(x) - near) ** 2).sum(axis=(1, 2)))
        return rest * (1 + 1e-9) + 1e-5 * np.sqrt((near * near).sum(axis=(1, 2))) + 1e-12 * np.sqrt((x * x).sum(axis=1))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x subspaces x 16: the product of each query's part with each codeword."""
        return np.einsum("qms,mks->qmk", self.parts(queries), self.words).astype(np.float32)


def fit(x: np.ndarray, rounds: int = 8, seed: int = 5) -> Codebook:
    """A codebook for rows x, by alternating the score-aware assignment with the least-squares codewords."""
    rng = np.random.default_rng(seed)
    n, size = x.shape
    spaces = -(-size // SUBSPACE)
    t2 = SCORE_THRESHOLD**2
    book = Codebook(np.zeros((spaces, CODEWORDS, SUBSPACE)), size, max(1.0, (size - 1) * t2 / (1 - t2)))
    parts = book.parts(x)
    book.words = parts[rng.choice(n, CODEWORDS, replace=n < CODEWORDS)].transpose(1, 0, 2).copy()
    toward = parts / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None, None]
    for step in range(rounds):
        codes = book.encode(x, rounds=0 if step < 3 else 2)
        extra = 0.0 if step < 3 else book.along - 1
        rest = parts - book.words[np.arange(spaces), codes]
        total = (rest * toward).sum(axis=(1, 2))
        for m in range(spaces):
            u, k = toward[:, m], codes[:, m]
            others = total - (rest[:, m] * u).sum(axis=1)
            goal = parts[:, m] + extra * u * (others + (parts[:, m] * u).sum(axis=1))[:, None]
            weigh = np.eye(SUBSPACE) + extra * u[:, :, None] * u[:, None, :]
            left, right = np.zeros((CODEWORDS, SUBSPACE, SUBSPACE)), np.zeros((CODEWORDS, SUBSPACE))
            np.add.at(left, k, weigh)
            np.add.at(right, k, goal)
            there = np.bincount(k, minlength=CODEWORDS) > 0
            book.words[m, there] = np.linalg.solve(left[there], right[there][:, :, None])[:, :, 0]
            rest[:, m] = parts[:, m] - book.words[m][k]
            total = others + (rest[:, m] * u).sum(axis=1)
    return book


def _packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return codes[:, ::2] | (codes[:, 1::2] << 4)


def _scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate products, queries x candidates: for each byte of codes, the sum of its two table entries."""
    out = np.empty((len(tables), len(packed)), dtype=np.float32)
    if tables.shape[1] % 2:
        tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
    both = tables[:, 1::2, :, None] + tables[:, ::2, None, :]  # by the byte that holds both codes
    both = np.ascontiguousarray(both.reshape(len(tables), -1, 256).transpose(1, 2, 0))
    for lo in range(0, len(packed), 2048):  # what a run of candidates sums up stays in the processor's cache
        codes = packed[lo : lo + 2048]
        total = both[0].take(codes[:, 0], axis=0)
        for b in range(1, packed.shape[1]):
            total += both[b].take(codes[:, b], axis=0)
        out[:, lo : lo + 2048] = total.T
    return out


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best, the first of equal ones."""
    if len(scores) <= most:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - most)[len(scores) - most]
    above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    return np.sort(np.concatenate([above, level[: most - len(above)]]))


def cells(x: np.ndarray, n: int) -> np.ndarray:
    """Centres of n coarse cells: the means of rows that point alike."""
    near = (unit(x) @ spherical_kmeans(unit(x), n).T).argmax(axis=1)
    return np.stack([x[near == c].mean(axis=0) for c in np.unique(near)])


def home(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cell of each row: the centre that points most alike."""
    length = np.sqrt((centres * centres).sum(axis=1))
    return (x @ (centres / np.maximum(length, 1e-300)[:, None]).T).argmax(axis=1)


def reach(x: np.ndarray, centres: np.ndarray, k: int, most: int = 1024) -> float:
    """How far below its best centre's score, in its own lengths, a query visits cells, by rows of the sample as queries.

    It is the least with which PROBED of them visit the cells of FOUND of their k nearest.
    """
    near, at = home(x, centres), np.arange(0, len(x), -(-len(x) // most))
    k = min(k, len(x) - 1)
    if k < 1:
        return np.inf
    scores = x[at] @ x.T
    scores[np.arange(len(at)), at] = -np.inf
    top = near[np.argpartition(-scores, k - 1, axis=1)[:, :k]]
    of_cells = x[at] @ centres.T
    below = of_cells.max(axis=1, keepdims=True) - np.take_along_axis(of_cells, top, axis=1)
    below /= np.maximum(np.sqrt((x[at] * x[at]).sum(axis=1, keepdims=True)), 1e-300)
    needed = np.sort(below, axis=1)[:, int(np.ceil(FOUND * k)) - 1]
    return float(np.sort(needed)[int(np.ceil(PROBED * len(needed))) - 1])


def visited(x: np.ndarray, centres: np.ndarray, far: float) -> np.ndarray:
    """Whether each row, as a query, visits each cell."""
    scores = x @ centres.T
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return scores >= scores.max(axis=1, keepdims=True) - far * length * (1 + 1e-9) - 1e-12 * length


class _Block:
    """The candidates of a block, ready to be searched."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).select(["vec_id", "vec", "codes", "error"]).sort_by("vec_id").combine_chunks()
        self.ids = table.column("vec_id").to_numpy()
        self.there = matrix(table.column("vec").combine_chunks())
        self.short = self.there.astype(np.float32)
        self.far = 1e-6 * np.sqrt(self.there.shape[1]) * np.sqrt((self.there * self.there).sum(axis=1))  # of short products
        self.error = table.column("error").to_numpy()
        self.packed = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(self.ids), -1)

    def search(self, book: Codebook, asking: np.ndarray, vecs: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(query ids, candidate ids, scores): the k nearest of the block, for each query."""
        own, there = self.ids, self.there
        step = max(1, min(64, (1 << 22) // len(own)))
        for lo in range(0, len(asking), step):
            part = slice(lo, lo + step)
            rough = _scan(book.tables(vecs[part]), self.packed)
            for q, vec, scores in zip(asking[part].tolist(), vecs[part], rough, strict=True):
                scores[own == q] = -np.inf
                best = _best(scores, max(RERANKED, k))
                best = best[own[best] != q]
                exact = (there[best] * vec).sum(axis=1)
                if len(best) >= k:  # with fewer, there are no others
                    least = np.partition(exact, len(exact) - k)[len(exact) - k]
                    length = np.sqrt((vec * vec).sum())
                    more = ~(scores + self.error * length < least) & (own != q)  # what isn't a number is no bound
                    more[best] = False
                    rest = np.flatnonzero(more)
                    rest = rest[~(self.short[rest] @ vec.astype(np.float32) + self.far[rest] * length < least)]
                    best = np.concatenate([best, rest])
                    exact = np.concatenate([exact, (there[rest] * vec).sum(axis=1)])
                top = np.lexsort((own[best], -exact))[:k]
                yield np.full(len(top), q), own[best[top]], exact[top]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """(id, vector) -> (query_id, rank int, vec_id, score): for each query its k nearest found, by inner product.

    Queries are the rows for which ``is_query`` holds; candidates are all rows but
    the query's own (those with its id).  score is the product of the original
    vectors in double precision; ties go to the smaller id.  Vectors that are null,
    zero, of another length than most, or hold null or non-finite components, and
    rows with a null id, take no part.  Repeated rows are candidates of their own.
    Other columns are ignored, whatever their names; an empty table gives none.

    Every row is indexed; what is fitted on at most SAMPLE rows is the codebook,
    the cells' centres (one for OF_CELL rows of the sample, at most) and a query's reach.  A block is held by one
    task, and the queries that visit it are read one batch after another; it gives
    one row a query, of its k nearest, and a query's rows are merged one by one.
    """
    spark = session(vectors)
    vec = named(vec_col)
    if vectors.select(vec.alias("v")).schema["v"].dataType.simpleString() not in ("array<float>", "array<double>"):
        vec = vec.cast("array<double>")
    rows = vectors.select(
        named(id_col).cast("long").alias("vec_id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")
    ).where(F.col("vec_id").isNotNull() & valid(F.col("vec")))
    sample = bounded_sample(rows.select("vec"), SAMPLE)
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vec") == sample.shape[1])
    n = rows.count()
    most = min(max(n // 64, CANDIDATES[0]), CANDIDATES[1], max(256, BLOCK_BYTES // (12 * sample.shape[1])))
    centres = cells(sample, max(1, min(n // most, len(sample) // OF_CELL)))
    shared = spark.sparkContext.broadcast((fit(sample), centres, reach(sample, centres, k)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, centres, far = shared.value
        names = ["vec_id", "vec", "asks", "codes", "error", "cell", "probes"]
        for batch in batches:
            x = matrix(batch.column(1))
            codes = book.encode(x)
            asks = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            probes = visited(x, centres, far) & asks[:, None]
            ends = np.concatenate([[0], np.cumsum(probes.sum(axis=1))]).astype(np.int32)
            own = [
                pa.array([c.tobytes() for c in _packed(codes)], pa.binary()),
                pa.array(book.errors(x, codes)),
                pa.array(home(x, centres).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(probes)[1].astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=names)

    kind = rows.schema["vec"].dataType.simpleString()
    schema = f"vec_id long, vec {kind}, asks boolean, codes binary, error double, cell int, probes array<int>"
    indexed = materialize(rows.mapInArrow(tidied(index), schema), "index")

    def parts(counts: DataFrame, size: int) -> Column:
        """By cell, how many parts of about ``size`` rows: one row a cell."""
        found = {r["cell"]: r["count"] for r in counts.groupBy("cell").count().collect()}
        return F.array(*[F.lit(-(-found.get(c, 0) // size)) for c in range(len(centres))])[F.col("cell")]

    asking = indexed.where("asks").select("vec_id", "vec", F.explode("probes").alias("cell"))
    across, down = parts(indexed, most), parts(asking, QUERIES)
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    here = F.struct("cell", "i", "j").alias("block")
    candidates = indexed.where(down > 0).withColumns({"i": F.pmod(spread, across), "j": F.explode(F.sequence(F.lit(0), down - 1))})
    queries = asking.where(across > 0).withColumns({"i": F.explode(F.sequence(F.lit(0), across - 1)), "j": F.pmod(spread, down)})
    met = candidates.select(here, F.lit(False).alias("asks"), "vec_id", "vec", "codes", "error").union(
        queries.select(here, F.lit(True), "vec_id", "vec", F.lit(None).cast("binary"), F.lit(None).cast("double"))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, asking in in_blocks(batches, _Block):
            ids, vecs = asking.column("vec_id").to_numpy(), matrix(asking.column("vec"))
            _, found, scores = zip(*block.search(shared.value[0], ids, vecs, k), strict=True)
            columns = [pa.array(ids), *(pa.array([x.tobytes() for x in y], pa.binary()) for y in (found, scores))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "ids", "scores"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranked(query: int, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
            columns = [np.full(len(ids), query), np.arange(1, len(ids) + 1, dtype=np.int32), ids, scores]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "rank", "vec_id", "score"])

        now, ids, scores = None, np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            for query, more, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if query != now:
                    if now is not None:
                        yield ranked(now, ids, scores)
                    now, ids, scores = query, np.zeros(0, np.int64), np.zeros(0)
                ids, scores = np.concatenate([ids, np.frombuffer(more, np.int64)]), np.concatenate([scores, np.frombuffer(other)])
                top = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[top], scores[top]
        if now is not None:
            yield ranked(now, ids, scores)

    met = met.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block", "asks")
    found = met.mapInArrow(tidied(search), "query_id long, ids binary, scores binary")
    found = found.repartition(shuffle_partitions(spark), "query_id").sortWithinPartitions("query_id")
    return found.mapInArrow(tidied(rank), "query_id long, rank int, vec_id long, score double")
