"""Approximate nearest neighbours by randomly rotated one-bit codes.

Each vector, divided by its length, is turned by a fixed random rotation and kept as the signs of its
components, one packed bit each, with one correction scalar: the inner product of the turned unit vector and
its code.  For a query, the inner product with the code divided by that scalar is an unbiased estimate
of the cosine, and the scalar also bounds the estimate's error.  A task reranks the best estimates of each
query by the exact cosine of the original vectors; the k best seen so far are then the bar, and of the other
vectors those whose upper bound falls below it are skipped and the rest reranked too.

Nothing is sampled: the rotation is drawn from a seed, every valid row is in the index.  Queries go to
the tasks in blocks of ``QUERY_BLOCK``; each block is compared with all rows, and each task returns its
own k best of each query, so what is shuffled is small.  Identical vectors are compared once a task batch: only the
k + 1 smallest ids of each can be among the nearest.

Defined cases: vectors that are NULL, zero, or hold NULL or non-finite components take no part, as query
or candidate; nor do vectors of another length than the most common one (of two as common, the shorter).
NULL ids take no part.  Equal cosines go to the smaller id; rows of one id other than the query's are
each a candidate, so a repeated row may appear twice.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.llm.common import field, kept

QUERY_BLOCK = 2048
#: Rows compared at once inside a task, and queries of a block.
ROW_STEP, QUERY_STEP = 4096, 256
#: Width of the error bound in standard deviations.
WIDTH = 4.0
INDEX = "vec_id bigint, code binary, scalar double, vector array<double>"


def rotation(d: int, seed: int = 17) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def valid(embeddings: DataFrame) -> DataFrame:
    """``vec_id, vector`` of the rows that take part."""
    e = F.col("vector")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(
        field(embeddings, "vec_id").cast("bigint").alias("vec_id"),
        field(embeddings, "embedding").cast("array<double>").alias("vector"),
    ).filter(F.col("vec_id").isNotNull() & e.isNotNull() & fine & F.exists(e, lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("vector") == (common["d"] if common else 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors divided by a power of two each, so that no square leaves the range of floats; cosines stay, to the last bit."""
    _, exponent = np.frexp(np.abs(x).max(1, initial=0, keepdims=True))
    return np.ldexp(x, -exponent)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return scaled(flat.reshape(len(column), -1))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs, and the inner product of each turned unit vector with its code."""
    d = vectors.shape[1]
    turned = (vectors / np.sqrt((vectors * vectors).sum(1))[:, None]) @ turn.T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(d)


def build_index(rows: DataFrame, seed: int = 17) -> DataFrame:
    """Code, scalar and original vector of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = None
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("vector"))
            turn = rotation(x.shape[1], seed) if turn is None else turn
            code, scalar = encode(x, turn)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scalar), b.column("vector")],
                ["vec_id", "code", "scalar", "vector"],
            )

    return rows.mapInArrow(run, INDEX)


class Exact:
    """Exact cosines of some pairs, summed in one fixed order: equal vectors get equal cosines wherever they lie."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        # One row a component, so that picking pairs reads neighbouring memory.
        self.a, self.b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        self.aa, self.bb = (sum((x * x for x in side[1:]), side[0] * side[0]) for side in (self.a, self.b))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        dot = np.zeros(len(i))
        for x, y in zip(self.a, self.b):
            dot += x[i] * y[j]
        return dot / np.sqrt(self.aa[i] * self.bb[j])


class Best:
    """The k best candidates of each query so far: cosine down, then id up."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(query)
        keep_q = np.concatenate([query, np.repeat(touched, self.k)])
        keep_i = np.concatenate([ids, self.id[touched].reshape(-1)])
        keep_s = np.concatenate([score, self.score[touched].reshape(-1)])
        order = np.lexsort((keep_i, -keep_s, keep_q))
        q = keep_q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = order[rank < self.k]
        self.id[keep_q[top], rank[rank < self.k]] = keep_i[top]
        self.score[keep_q[top], rank[rank < self.k]] = keep_s[top]


def few_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k + 1 smallest ids of each distinct vector."""
    keys = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).reshape(-1)
    _, group = np.unique(keys, return_inverse=True)
    order = np.lexsort((ids, group))
    g = group[order]
    return np.sort(order[np.arange(len(g)) - np.searchsorted(g, g) <= k])


def compare(index_rows: tuple, queries: tuple, best: Best, turn: np.ndarray, width: float) -> None:
    """Bring ``best`` up to date with some rows of the index: ids, codes, scalars, vectors."""
    ids, code, scalar, x = index_rows
    qid, q = queries
    d = x.shape[1]
    unit = (q / np.sqrt((q * q).sum(1))[:, None]) @ turn.T
    signs = np.unpackbits(code, axis=1, count=d).astype(np.float64) * 2 - 1
    # Error of the estimate: what of the vector its code misses, over the code's share.
    error = width * np.sqrt(np.maximum(1 - scalar**2, 0)) / scalar / np.sqrt(max(d - 1, 1))
    exact = Exact(q, x)
    for lo in range(0, len(qid), QUERY_STEP):
        part = slice(lo, lo + QUERY_STEP)
        guess = (unit[part] @ signs.T) / np.sqrt(d) / scalar
        same = qid[part][:, None] == ids
        guess[same] = -np.inf
        k = best.k
        # The best estimates are reranked first: their exact cosines are the bar for all others.
        ahead = min(2 * k, len(ids))
        first = np.argpartition(guess, len(ids) - ahead, axis=1)[:, len(ids) - ahead :]
        row, col = np.repeat(np.arange(len(guess)), ahead), first.reshape(-1)
        row, col = row[guess[row, col] > -np.inf], col[guess[row, col] > -np.inf]
        best.add(row + lo, ids[col], exact.of(row + lo, col))
        guess[row, col] = -np.inf
        row, col = np.nonzero(guess + error >= best.score[part, k - 1][:, None])
        row, col = row[guess[row, col] > -np.inf], col[guess[row, col] > -np.inf]
        for a in range(0, len(row), 200_000):
            r, c = row[a : a + 200_000], col[a : a + 200_000]
            score = exact.of(r + lo, c)
            good = score >= best.score[r + lo, k - 1]
            if good.any():
                best.add(r[good] + lo, ids[c][good], score[good])


def search(index: DataFrame, queries: DataFrame, k: int = 5, seed: int = 17, width: float = WIDTH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each query (``vec_id``, ``vector``) but itself."""
    schema = "query_id bigint, vec_id bigint, score double"
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    if n > 1:
        index = kept(index, "codes")
    found = []
    for block in range(n):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == block).select("vec_id", "vector").distinct()
        rows = sorted(part.collect(), key=lambda r: (r["vec_id"], r["vector"]))
        if not rows:
            continue
        q = (np.array([r["vec_id"] for r in rows], np.int64), scaled(np.array([r["vector"] for r in rows], np.float64)))
        shared = index.sparkSession.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, vectors = shared.value
            turn = rotation(vectors.shape[1], seed)
            best = Best(len(qid), k)
            for b in batches:
                for lo in range(0, b.num_rows, ROW_STEP):
                    piece = b.slice(lo, ROW_STEP)
                    ids, x = piece.column("vec_id").to_numpy(), _matrix(piece.column("vector"))
                    few = few_copies(ids, x, k)
                    code = np.frombuffer(b"".join(piece.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                    scalar = piece.column("scalar").to_numpy()
                    compare((ids[few], code[few], scalar[few], x[few]), (qid, vectors), best, turn, width)
            row, rank = np.nonzero(best.score > -np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(qid[row]), pa.array(best.id[row, rank]), pa.array(best.score[row, rank])],
                ["query_id", "vec_id", "score"],
            )

        found.append(index.mapInArrow(run, schema))
    if not found:
        return index.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, asks: Column, k: int = 5) -> DataFrame:
    """The k nearest of the rows for which ``asks`` (on ``vec_id``) holds, among all rows."""
    rows = valid(embeddings)
    return search(build_index(rows), rows.filter(asks), k)


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
w AS (SELECT * FROM v WHERE len(e) = (SELECT len(e) FROM v GROUP BY len(e) ORDER BY count(*) DESC, len(e) LIMIT 1)),
c AS (
  SELECT q.vec_id AS query_id, w.vec_id, list_inner_product(q.e, w.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(w.e, w.e)) AS score
  FROM w AS q JOIN w ON q.vec_id <> w.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM c)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("vec_id") % 50 == 0)
