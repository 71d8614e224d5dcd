"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Rows belong to a fixed number of source partitions by a hash of their content, so a task that runs again
   sees the same rows. One count per partition goes to the driver: a table of bounded size.
2. The driver draws how many rows each partition sends to each cell of each shard (multivariate
   hypergeometric, row by row of the matrix). All rows of a cell together make up exactly its size.
3. Each partition orders its rows by a hash, which permutes them, and cuts that order by its matrix row.
4. Cells exchange their rows and order them by a second hash; the place in that order, after the cells
   before it in the shard, is the slot.

Cells bound what one task sorts. Null ids and texts hash like values; rows equal in all columns are
interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARDS = 40
CELLS = 8
PARTITIONS = 512
SEED = 20240601
#: numpy draws hypergeometric numbers exactly for populations below this; above it their normal limit is drawn.
EXACT_POPULATION = 10**9

CUTS = T.StructType([
    T.StructField("_part", T.IntegerType(), False),
    T.StructField("_shard_cuts", T.ArrayType(T.LongType(), False), False),
    T.StructField("_cell_cuts", T.ArrayType(T.ArrayType(T.LongType(), False), False), False),
])


def cell_sizes(rows: int, shards: int, cells: int) -> np.ndarray:
    """Exact size of each cell: shards differ by one row at most, and so do the cells of a shard."""
    at = [rows * s // shards for s in range(shards + 1)]
    return np.array([
        [(b - a) * (c + 1) // cells - (b - a) * c // cells for c in range(cells)] for a, b in zip(at, at[1:])
    ], dtype=np.int64).reshape(shards, cells)


def draw(rng: np.random.Generator, free: int, others: int, sent: int) -> int:
    """How many of ``sent`` rows fall on ``free`` of ``free + others`` open places."""
    if free + others < EXACT_POPULATION:
        return int(rng.hypergeometric(free, others, sent)) if sent else 0
    total = free + others
    share = free / total
    spread = (sent * share * (1 - share) * (total - sent) / max(1, total - 1)) ** 0.5
    return min(free, sent, max(0, sent - others, round(rng.normal(sent * share, spread))))


def communication_matrix(sent: list[int], sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """``matrix[p, shard, cell]`` rows from partition ``p``; margins are ``sent`` and ``sizes``.

    Each partition splits its rows over the shards, then those of a shard over its cells.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    free = sizes.astype(np.int64).copy()
    matrix = np.zeros((len(sent), *sizes.shape), dtype=np.int64)

    def split(left: int, places: np.ndarray) -> np.ndarray:
        out, open_places = np.zeros(len(places), dtype=np.int64), int(places.sum())
        for k, here in enumerate(places.tolist()):
            if not left:
                break
            open_places -= here
            out[k] = draw(rng, here, open_places, left)
            left -= int(out[k])
        return out

    for p, rows in enumerate(sent):
        for shard, count in enumerate(split(rows, free.sum(axis=1))):
            matrix[p, shard] = split(int(count), free[shard])
        free -= matrix[p]
    return matrix


def shuffle_into_shards(
    rows: DataFrame, shards: int = SHARDS, *, cells: int = CELLS, partitions: int = PARTITIONS, seed: int = SEED
) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (from 0, without gaps): a uniform shuffle with exact shard sizes."""
    columns = rows.columns
    name = "_key"
    hashed = rows.withColumn(name, F.xxhash64(F.lit(seed), *columns)).withColumn(
        "_part", F.pmod(name, F.lit(partitions)).cast("int")
    )
    counts = dict(hashed.groupBy("_part").count().collect())  # at most ``partitions`` rows
    sizes = cell_sizes(sum(counts.values()), shards, cells)
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], sizes, seed)
    table = [
        (p, np.cumsum(m.sum(axis=1)).tolist(), np.cumsum(m, axis=1).tolist()) for p, m in zip(parts, matrix, strict=True)
    ]
    cuts = rows.sparkSession.createDataFrame(table, CUTS)
    local = Window.partitionBy("_part").orderBy(F.xxhash64(name, F.lit("local")), *columns)
    # the matrix has partitions x shards x cells numbers, whatever the size of the table
    placed = hashed.withColumn("_place", F.row_number().over(local) - 1).join(F.broadcast(cuts), "_part")
    passed = lambda cut: F.size(F.filter(cut, lambda c: c <= F.col("_place")))
    placed = placed.withColumn("shard", passed(F.col("_shard_cuts")))
    start = F.when(F.col("shard") > 0, F.get("_shard_cuts", F.col("shard") - 1)).otherwise(F.lit(0))
    placed = placed.withColumn("_place", F.col("_place") - start)
    placed = placed.withColumn("_cell", passed(F.get("_cell_cuts", F.col("shard"))))
    starts = F.array(*[F.array(*[F.lit(int(x)) for x in (np.cumsum(row) - row)]) for row in sizes])
    final = Window.partitionBy("shard", "_cell").orderBy(F.xxhash64(name, F.lit("final")), *columns)
    before = F.get(F.get(starts, F.col("shard")), F.col("_cell"))
    slot = F.row_number().over(final) - 1 + before
    return placed.withColumn("slot", slot.cast("bigint")).select(*columns, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, **options: int) -> DataFrame:
    """Place of each document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the UTF-8 length of the text plus 16; a null text counts as empty. The law is ``rows``:
    shard counts differ by one at most. ``grown_shard`` is null, as ids do not decide.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shuffle_into_shards(narrow, shards, **options).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
