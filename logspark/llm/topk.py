"""Exact top-k by inner product: branch and bound over blocks of dimensions in vertical layout.

Vectors are packed into blocks, one array per block of dimensions, and so are the queries. A task takes one block
of vectors and one block of queries and adds up scores, a few dimensions at a time. After each step the remaining
mass bounds what a vector can still gain or lose: the product of the norms of what is left of query and vector.
A vector whose best score is below the k-th best guaranteed score of every query that still needs it leaves the
block, and the rest is packed together again. What survives is exact; blocks are merged by rank.

Components become floor(1024 x) as integers. Vectors that are null or hold a null or a value that is not finite
take no part, as queries or as candidates; vectors of different lengths are filled up with zeros. A query does not
find its own row; repeated ids count as rows, except that all rows with the query's own id are left out. Rows with
a null id take no part. Ties go to the smaller id; identical rows share their rank order arbitrarily. Scores are
added in double precision while their bound allows, else as Python integers; scores beyond 64 bits are clamped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.session import materialise

K = 10
SCALE = 1024
QUERY_STEP = 100
#: Vectors and queries in a block, queries scored together, dimensions in a step.
BLOCK_ROWS = 4096
BLOCK_QUERIES = 2048
QUERIES_AT_ONCE = 128
STEP = 8
EXACT = float(1 << 53)
LIMIT = (1 << 63) - 1


def scaled(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: floor(SCALE * component) as whole doubles, of the vectors that take part."""
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double")).alias("x"), "embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite)).select("vec_id", "x")


def vertical(vectors: pa.Array) -> np.ndarray:
    """Matrix with a column per vector, filled up with zeros below short ones."""
    lengths = vectors.value_lengths().to_numpy()
    dims = int(lengths.max(initial=0))
    values = vectors.flatten().to_numpy()
    if (lengths == dims).all():
        return np.ascontiguousarray(values.reshape(-1, dims).T)
    matrix = np.zeros((len(lengths), dims))
    matrix[np.arange(dims) < lengths[:, None]] = values
    return np.ascontiguousarray(matrix.T)


def packed(ids: pa.Array, vectors: pa.Array) -> list[pa.Array]:
    """One row ``ids, columns, dims`` of a block."""
    matrix = vertical(vectors)
    ids = ids.to_numpy().astype(np.int64)
    return [pa.array([ids.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary()), pa.array([len(matrix)], pa.int32())]


def vector_blocks(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays(packed(*batch.columns), ["ids", "columns", "dims"])

    return vectors.select("vec_id", "x").mapInArrow(run, "ids binary, columns binary, dims int")


def query_blocks(queries: DataFrame, count: int) -> DataFrame:
    """``q_block`` from 0 to ``count - 1`` and its packed queries; a hash of the id deals them out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rows = batch.column(1)[row].values
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, 1), *packed(rows.field("vec_id"), rows.field("x"))], ["q_block", "q_ids", "q_columns", "q_dims"]
                )

    block = F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    grouped = queries.groupBy(block.alias("q_block")).agg(F.collect_list(F.struct("vec_id", "x")).alias("rows"))
    return grouped.mapInArrow(run, "q_block int, q_ids binary, q_columns binary, q_dims int")


def unpack(ids: bytes, columns: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(columns, np.float64).reshape(dims, len(ids))


def kth_largest(scores: np.ndarray, k: int) -> np.ndarray:
    """k-th largest value of each row, minus infinity where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int = K, step: int = STEP):
    """``query, vector, score`` arrays of the ``k`` best rows of a block for each query, without its own rows."""
    dims = max(len(queries), len(columns))
    queries = np.vstack([queries, np.zeros((dims - len(queries), queries.shape[1]))])
    columns = np.vstack([columns, np.zeros((dims - len(columns), columns.shape[1]))])
    largest = lambda m: np.sqrt((m**2).sum(axis=0).max(initial=0)) + 1
    if not largest(queries) * largest(columns) < EXACT / 4:
        return exhaustive(query_ids, queries, ids, columns, k)
    # dimensions with the most mass first, so that bounds close early
    mass = np.abs(queries).sum(axis=1) * np.abs(columns).sum(axis=1)
    order = np.argsort(-mass, kind="stable")
    queries, columns = queries[order], columns[order]
    left_q, left_v = remaining(queries), remaining(columns)
    own = query_ids[:, None] == ids[None, :]
    scores, alive = np.zeros((len(query_ids), len(ids))), np.arange(len(ids))
    for at in range(0, dims, step):
        until = min(dims, at + step)
        scores += queries[at:until].T @ columns[at:until]
        slack = left_q[until][:, None] * left_v[until][None, :]
        slack += 1e-6 * (1 + slack)  # rounding of the norms; the scores are whole numbers and exact
        worst = np.where(own, -np.inf, scores - slack)
        wanted = (scores + slack >= kth_largest(worst, k)[:, None]) & ~own
        keep = wanted.any(axis=0)
        if until < dims and keep.mean() < 0.8:
            alive, columns, left_v = alive[keep], columns[:, keep], left_v[:, keep]
            scores, own = scores[:, keep], own[:, keep]
    final = np.where(own, -np.inf, scores)
    q, v = np.nonzero((final >= kth_largest(final, k)[:, None]) & ~own)
    return best(query_ids[q], ids[alive[v]], final[q, v].astype(np.int64), k)


def remaining(matrix: np.ndarray) -> np.ndarray:
    """Norm of each column from a dimension on; a last row of zeros stands for nothing left."""
    return np.sqrt(np.vstack([np.cumsum((matrix**2)[::-1], axis=0)[::-1], np.zeros((1, matrix.shape[1]))]))


def exhaustive(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int):
    """The same with unbounded integers, for components too large for doubles."""
    out = []
    whole = [[int(x) for x in v] for v in columns.T]
    for query, x in zip(query_ids.tolist(), queries.T, strict=True):
        x = [int(a) for a in x]
        for vector, y in zip(ids.tolist(), whole, strict=True):
            if vector != query:
                out.append((query, vector, max(-LIMIT - 1, min(LIMIT, sum(a * b for a, b in zip(x, y, strict=True))))))
    table = np.array(out, dtype=np.int64).reshape(-1, 3)
    return best(table[:, 0], table[:, 1], table[:, 2], k)


def best(query: np.ndarray, vector: np.ndarray, score: np.ndarray, k: int):
    """First ``k`` rows of each query by score, then by smaller vector id."""
    order = np.lexsort((vector, ~score, query))
    query, vector, score = query[order], vector[order], score[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.array([], dtype=int)
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    return query[rank < k], vector[rank < k], score[rank < k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``vectors`` with the highest scores for each query.

    Both sides have ``vec_id`` and ``x``. Each block of queries meets each block of vectors once.
    """
    count = -(-queries.count() // BLOCK_QUERIES)
    asked = materialise(query_blocks(queries, max(1, count)), "topk-queries")
    pairs = vector_blocks(vectors).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(max(0, count - 1)))))
    pairs = pairs.join(asked, "q_block").select("q_ids", "q_columns", "q_dims", "ids", "columns", "dims")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                query_ids, asked_for = unpack(*row[:3])
                block = unpack(*row[3:])
                for at in range(0, len(query_ids), QUERIES_AT_ONCE):
                    part = slice(at, at + QUERIES_AT_ONCE)
                    found = search(query_ids[part], asked_for[:, part], *block, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k_of_table(vectors: DataFrame, step: int = QUERY_STEP, k: int = K) -> DataFrame:
    """Search for every row whose id is divisible by ``step`` among all others."""
    rows = scaled(vectors)
    return top_k(rows, rows.where(F.col("vec_id") % step == 0), k)
