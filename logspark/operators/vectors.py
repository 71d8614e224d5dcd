"""Token vectors: training, lookup, pooling, window context, reconstruction error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, PCAModel, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.session import materialise

TASK_WORDS = 4_000_000  # words that one training task takes before there is another one


def training_tasks(words: int, least: int = 4) -> int:
    """Tasks that train on a corpus of ``words`` words: ``least`` of them as long as each gets through its share."""
    return max(least, -(-words // TASK_WORDS))


def token_embeddings(
    corpus: DataFrame, dim: int = 100, window: int = 5, epochs: int = 10, min_count: int = 1, seed: int = 42,
    partitions: int = 4,
) -> DataFrame:
    """``token, vector`` of a skip-gram model over ``array<string>`` sentences.

    Each of ``partitions`` tasks trains on its share and the partial models are averaged, so fewer give
    better vectors; ``training_tasks`` gives more of them only to corpora that four tasks do not get through.
    """
    model = Word2Vec(
        vectorSize=dim, windowSize=window, maxIter=epochs, minCount=min_count, seed=seed, numPartitions=partitions,
        inputCol="tokens", outputCol="pooled",
    ).fit(corpus)
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vector"))


def embed_tokens(df: DataFrame, vectors: DataFrame, token: str, dim: int) -> DataFrame:
    """Add ``vector``; a token without one gets zeros.

    The vector table grows with the vocabulary. It is written, so that a small one is broadcast by its true size and
    events of a frequent token stay in place.
    """
    zeros = F.array_repeat(F.lit(0.0), dim)
    known = materialise(vectors.select(F.col("token").alias(token), "vector"), "vectors")
    return df.join(known, token, "left").withColumn("vector", F.coalesce("vector", zeros))


def mean_pool(df: DataFrame, keys: list[str], token: str, vectors: DataFrame, dim: int) -> DataFrame:
    """Mean vector of the known tokens of each key, zeros when it knows none.

    Tokens are counted per key before vectors are attached, and sums are merged by partial aggregation.
    """
    counts = df.groupBy(*keys, token).agg(F.count(F.lit(1)).alias("_n"))
    known = vectors.select(F.col("token").alias(token), "vector")
    hits = counts.join(known, token, "left")
    have = F.sum(F.when(F.col("vector").isNotNull(), F.col("_n")))
    sums = [F.sum(F.col("vector")[i] * F.col("_n")).alias(f"_v{i}") for i in range(dim)]
    pooled = hits.groupBy(*keys).agg(have.alias("_have"), *sums)
    means = F.array(*[F.coalesce(F.col(f"_v{i}") / F.col("_have"), F.lit(0.0)) for i in range(dim)])
    return pooled.select(*keys, means.alias("vector"))


def context_vector(vectors: Column, dim: int) -> Column:
    """Position-weighted mean of the vectors of a window; later events weigh more. Row-local.

    Keeps the contract of a recurrent context (window in, one vector out), not its numbers.
    """
    n = F.size(vectors)
    total = (n * (n + 1) / 2).cast("double")
    weighted = lambda i: F.aggregate(
        F.zip_with(vectors, F.sequence(F.lit(1), n), lambda v, w: F.element_at(v, i + 1).cast("double") * w),
        F.lit(0.0), lambda a, x: a + x,
    )
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: weighted(i) / total)


def window_contexts(windows: DataFrame, ids: str, vectors: DataFrame, dim: int) -> DataFrame:
    """``windows`` with ``vector`` instead of ``ids``: the position-weighted mean of the vectors of its ids.

    ``vectors`` is ``ids, vector`` with dense small ids; an id without a vector counts as zeros. The table goes to every
    task as one matrix, no more than training has sent before (a row per token); a batch of windows is then looked up
    position by position, and no window is taken apart or moved.
    """
    known = vectors.toPandas()
    rows = np.zeros((int(known[ids].max()) + 2 if len(known) else 1, dim))  # the last row stays empty, for unknown ids
    if len(known):
        rows[known[ids].to_numpy()] = np.vstack(known["vector"].to_numpy())
    shared = windows.sparkSession.sparkContext.broadcast(rows)
    kept = [f for f in windows.schema.fields if f.name != ids]
    schema = T.StructType([*kept, T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            lists = batch.column(ids)
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            flat = np.where((flat >= 0) & (flat < len(table)), flat, len(table) - 1)
            ends = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
            begins, sizes = ends[:-1], np.diff(ends)
            sums = np.zeros((len(sizes), dim))
            for i in range(sizes.max(initial=0)):
                at = np.flatnonzero(sizes > i)
                sums[at] += (i + 1) * table[flat[begins[at] + i]]
            means = sums / np.maximum(sizes * (sizes + 1) / 2, 1)[:, None]
            offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * dim)
            vector = pa.ListArray.from_arrays(offsets, pa.array(means.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], vector], schema.names)

    return windows.mapInArrow(mean, schema)


def fit_reconstruction(normal: DataFrame, vector: str = "vector", k: int = 8) -> PCAModel:
    """Linear autoencoder: principal components of normal rows."""
    rows = normal.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_x"))
    return PCA(k=k, inputCol="_x", outputCol="_z").fit(rows)


def reconstruction(df: DataFrame, model: PCAModel, vector: str = "vector") -> DataFrame:
    """Add ``latent``, ``error`` (mean squared residual) and ``latent_norm``.

    The components are orthonormal, so the squared residual is the squared length of a row minus that
    of its latent part, for the same uncentred projection the model applies.
    """
    dim = model.pc.numRows
    x = F.col(vector).cast("array<double>")
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    projected = model.transform(df.withColumn("_x", array_to_vector(x)))
    return projected.withColumn("latent", vector_to_array("_z")).withColumns({
        "error": F.greatest(F.lit(0.0), (square(x) - square(F.col("latent"))) / F.lit(float(dim))),
        "latent_norm": F.sqrt(square(F.col("latent"))),
    }).drop("_x", "_z")
