"""Batch and streaming sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.functions.text import BLOCK_ID_PATTERN, strip
from logspark.operators.ordering import dense_ids
from logspark.schema import GROUND_TRUTH, RAW_STREAM, TOKEN_STREAM, UNIFIED_EVENTS
from logspark.session import materialise, small_table


def text_lines(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """``file, line_no, line`` of text files; numbers are 0-based per file and written once.

    With ``across`` the files are parts of one text in the order of their names, and numbers go on from part to part.
    The scan keeps file order inside a split and numbers splits by offset, so the row id orders the
    lines of a file; the lines of earlier splits are added from a table with one row per split.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_m"),
        F.col("value").alias("line"),
    )
    raw = materialise(raw, "lines")
    splits = raw.groupBy("file", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    along = Window.orderBy("file", "_at") if across else Window.partitionBy("file").orderBy("_at")
    before = F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "_at", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    splits = small_table(splits, "splits")
    return raw.join(splits, ["file", "_at"]).select(
        "file", (F.col("_before") + F.col("_m") - F.col("_first")).alias("line_no"), "line"
    )


def block_lines(lines: DataFrame, dataset: str = "hdfs") -> DataFrame:
    """Lines that name a block; the block is the session."""
    block = F.regexp_extract("line", BLOCK_ID_PATTERN, 1)
    return lines.where(F.col("line").rlike(BLOCK_ID_PATTERN)).select(
        "line_no",
        F.lit(None).cast("double").alias("timestamp"),
        F.lit(dataset).alias("dataset"),
        block.alias("session_id"),
        strip(F.col("line")).alias("message"),
    )


def chunk_lines(
    lines: DataFrame, size: int = 50, dataset: str = "bgl", is_anomaly: Column | None = None
) -> DataFrame:
    """Consecutive chunks of ``size`` lines as sessions ``window_<i>``.

    Lines with a ``file`` column are cut file by file: it stays, and names the session together with the chunk.

    The default label rule, 1 for a line that starts with ``-``, is kept for compatible results; in
    the public corpus that mark means "no alert", so pass ``is_anomaly`` to turn it round.
    """
    rule = F.col("line").startswith("-") if is_anomaly is None else is_anomaly
    chunk = F.concat(F.lit("window_"), F.floor(F.col("line_no") / size).cast("string"))
    file = ["file"] if "file" in lines.columns else []
    return lines.select(
        *file,
        "line_no",
        F.lit(None).cast("double").alias("timestamp"),
        F.lit(dataset).alias("dataset"),
        (F.concat(F.col("file"), F.lit("#"), chunk) if file else chunk).alias("session_id"),
        strip(F.col("line")).alias("message"),
        rule.cast("int").alias("label"),
    )


def number_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """Add a global 0-based ``line_no`` over the unique order of a table that has none."""
    return dense_ids(df, order, "line_no", kind="bigint").withColumn("line_no", F.col("line_no") - 1)


def read_unified(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    """Unified event CSV with pinned types and an optional row cap."""
    df = spark.read.schema(UNIFIED_EVENTS).option("header", True).option("escape", '"').csv(path)
    return df if nrows is None else df.limit(nrows)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """``session_id, label`` from a ``BlockId,Label`` CSV."""
    return ground_truth(spark.read.schema(GROUND_TRUTH).option("header", True).csv(path))


def ground_truth(labels: DataFrame) -> DataFrame:
    """Label text to 0 for ``Normal`` and 1 for everything else."""
    text = strip(F.coalesce(F.col("Label"), F.lit("")))
    return labels.select(
        strip(F.col("BlockId")).alias("session_id"), F.when(text == "Normal", 0).otherwise(1).alias("label")
    )


def stream_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """File stream with an explicit schema; columns outside it are ignored."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def token_events(df: DataFrame) -> DataFrame:
    """Event contract of the token stream: defaults filled, other columns dropped."""
    have = set(df.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast(TOKEN_STREAM[c].dataType)
    return df.select(
        F.coalesce(col("timestamp"), F.lit(0.0)).alias("timestamp"),
        F.col("service"),
        F.coalesce(col("session_id"), F.lit("")).alias("session_id"),
        F.col("token_id").cast("int").alias("token_id"),
        col("label").cast("int").alias("label"),
    )


def raw_events(df: DataFrame) -> DataFrame:
    """Event contract of the raw-line stream; timestamp 0 means the time of processing."""
    have = set(df.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast(RAW_STREAM[c].dataType)
    now = F.unix_micros(F.current_timestamp()) / 1e6
    return df.select(
        F.col("raw_log"),
        F.coalesce(col("service"), F.lit("default")).alias("service"),
        F.coalesce(col("session_id"), F.lit("")).alias("session_id"),
        F.coalesce(F.nullif(col("timestamp"), F.lit(0.0)), now).alias("timestamp"),
    )
