"""Stratified samples and splits with exact quotas, by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.operators.ordering import rank_boundaries


def hash_order(row_id: str, seed: str = "") -> tuple[Column, Column]:
    """``(number, text)`` of a uniform order that only depends on the row id and the seed."""
    text = F.md5(F.concat(F.lit(seed), F.col(row_id).cast("string")))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("bigint"), text


def hash_boundaries(df: DataFrame, strata: list[str], row_id: str, ranks: DataFrame, cuts: list[str], seed: str = "") -> DataFrame:
    """Hash order at given ranks of each stratum; 65,536 even slices bound what has to be ranked."""
    number, text = hash_order(row_id, seed)
    return rank_boundaries(df, strata, F.shiftright(number, 36), [*_order(number, text), F.col(row_id)], ranks, cuts)


def _order(number: Column, text: Column) -> list[Column]:
    return [number.alias("h"), text.alias("hs")]


def _before(row_id: str, seed: str, boundary: str) -> Column:
    """Rows ahead of a boundary in hash order; a null boundary lies behind all rows."""
    number, text = hash_order(row_id, seed)
    here = F.struct(*_order(number, text), F.col(row_id))
    return F.col(boundary).isNull() | (here < F.col(boundary))


def stratum_quotas(df: DataFrame, strata: list[str], target: int) -> DataFrame:
    """``strata, n, quota``: proportional shares rounded half to even, the last stratum takes the rest."""
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    # one row per stratum: label and source combinations, not data
    everything, ordered = Window.partitionBy(), Window.orderBy(*strata)
    share = F.bround(F.col("n") / F.sum("n").over(everything) * target).cast("bigint")
    last = F.row_number().over(ordered) == F.count(F.lit(1)).over(everything)
    shared = counts.withColumn("_share", share).withColumn("_last", last)
    others = F.sum(F.when(F.col("_last"), 0).otherwise(F.col("_share"))).over(everything)
    quota = F.when(F.col("_last"), target - others).otherwise(F.col("_share"))
    return shared.withColumn("quota", quota).drop("_share", "_last")


def stratified_sample(df: DataFrame, strata: list[str], row_id: str, target: int, seed: str = "") -> DataFrame:
    """Exactly ``target`` rows, proportional per stratum, the lowest hashes of each.

    The hash at which each stratum fills its quota is found first; the sample itself is then a filter
    over the data, so no stratum is sorted or moved.
    """
    quotas = stratum_quotas(df, strata, target).select(*strata, "quota")
    cut = hash_boundaries(df, strata, row_id, quotas, ["quota"], seed)
    return df.join(cut, strata).where(_before(row_id, seed, "quota")).select(*df.columns)


def sample_report(full: DataFrame, sample: DataFrame, strata: list[str]) -> DataFrame:
    """Input rows, sampled rows and fraction per stratum."""
    count = lambda d, name: d.groupBy(*strata).agg(F.count(F.lit(1)).alias(name))
    return count(full, "input_rows").join(count(sample, "sampled_rows"), strata, "left").select(
        *strata, "input_rows",
        F.coalesce("sampled_rows", F.lit(0)).alias("sampled_rows"),
        (F.coalesce("sampled_rows", F.lit(0)) / F.col("input_rows")).alias("fraction"),
    )


def split_stratified(
    df: DataFrame, row_id: str, label: str = "label", val_ratio: float = 0.1, test_ratio: float = 0.1, seed: str = "",
) -> DataFrame:
    """Add ``split``; every label gives at least one row to test and then to val, the rest to train.

    Like the sample, a comparison of each row with the two boundaries of its label.
    """
    n = F.count(F.lit(1))
    n_test = F.greatest(F.lit(1), F.bround(n * F.lit(test_ratio)).cast("bigint"))
    n_val = F.greatest(F.lit(1), F.bround(n * F.lit(val_ratio)).cast("bigint"))
    # wrapped, so that a null label is a class of its own in all joins
    classed = df.withColumn("_class", F.struct(F.col(label).alias("label")))
    ranks = classed.groupBy("_class").agg(n_test.alias("_test"), (n_test + n_val).alias("_val"))
    cut = hash_boundaries(classed, ["_class"], row_id, ranks, ["_test", "_val"], seed)
    split = (
        F.when(_before(row_id, seed, "_test"), "test").when(_before(row_id, seed, "_val"), "val").otherwise("train")
    )
    return classed.join(cut, "_class").withColumn("split", split).select(*df.columns, "split")
