"""Explicit schemas of every source and of the main intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIFIED_EVENTS = T.StructType([
    T.StructField("line_no", T.LongType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("label", T.ByteType()),
])

GROUND_TRUTH = T.StructType([
    T.StructField("BlockId", T.StringType()),
    T.StructField("Label", T.StringType()),
])

TOKEN_STREAM = T.StructType([
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("service", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("token_id", T.IntegerType()),
    T.StructField("label", T.IntegerType()),
])

RAW_STREAM = T.StructType([
    T.StructField("raw_log", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
])


def missing_columns(df: DataFrame, required: list[str], forbidden: list[str] = ()) -> list[tuple[str, str]]:
    """``(column, problem)`` pairs: required columns that are absent, old columns that leak through."""
    have = set(df.columns)
    return [(c, "missing") for c in required if c not in have] + [
        (c, "must not exist") for c in forbidden if c in have
    ]


def require(df: DataFrame, required: list[str], forbidden: list[str] = ()) -> DataFrame:
    """``df`` itself, or an error naming every schema problem."""
    problems = missing_columns(df, required, forbidden)
    if problems:
        raise ValueError("; ".join(f"{c}: {p}" for c, p in problems))
    return df


def column_report(df: DataFrame, required: list[str]) -> DataFrame:
    """One row per required column with the rows that hold a value in it."""
    present = [c for c in required if c in df.columns]
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in present]
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(c in present).alias("present"),
            (F.col(c) if c in present else F.lit(0)).cast("bigint").alias("n_values"),
            F.col("_rows").alias("n_rows"),
        )
        for c in required
    ]
    return counted.select(F.inline(F.array(*entries)))
