"""Rolling windows per stream key and their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.text import snippet
from logspark.operators.ordering import count_windows
from logspark.operators.templates import OFFSET


def rolling_windows(
    df: DataFrame, order: list[str], window: int = 50, stride: int = 10,
    key: str = "stream_key", values: list[str] = (), **kw,
) -> DataFrame:
    """Windows emitted at event ``window``, ``window + stride``, ... of each key.

    Columns: the key, ``emit_index`` from 0, ``sequence_id``, ``tokens``, ``timestamps``, ``label`` (highest
    non-null label or null) and one array per extra value.
    """
    columns = list(dict.fromkeys(["token_id", "timestamp", "label", *values]))
    cut = count_windows(df, [key], order, columns, window, stride, **kw)
    index = F.floor(F.col("start") / stride)
    return cut.select(
        key,
        index.alias("emit_index"),
        F.concat(F.col(key), F.lit("_w"), index.cast("string")).alias("sequence_id"),
        F.col("rows.token_id").alias("tokens"),
        F.col("rows.timestamp").alias("timestamps"),
        F.array_max("rows.label").alias("label"),
        *[F.col(f"rows.{v}").alias(v) for v in values],
    )


def template_ids(tokens: Column) -> Column:
    """Template ids of the tokens that stand for a template."""
    return F.transform(F.filter(tokens, lambda t: t >= OFFSET), lambda t: t - OFFSET)


def evidence(windows: DataFrame) -> DataFrame:
    """Add ``evidence_window``: first 20 tokens and template ids, first and last time. Row-local."""
    ids = template_ids(F.col("tokens"))
    return windows.withColumn(
        "evidence_window",
        F.struct(
            F.slice("tokens", 1, 20).alias("tokens"),
            F.slice(ids, 1, 20).alias("template_ids"),
            F.element_at("timestamps", 1).alias("window_start_ts"),
            F.element_at("timestamps", -1).alias("window_end_ts"),
        ),
    )


def template_previews(windows: DataFrame, dictionary: DataFrame, key: list[str], n: int = 5) -> DataFrame:
    """Add ``templates_preview``, text lines of the first ``n`` templates of a window.

    ``key`` must name a row. Other columns travel through the regrouping, so run this on the few rows
    that need text, such as fired alerts.
    """
    ids = F.slice(template_ids(F.col("tokens")), 1, n)
    rest = [c for c in windows.columns if c not in key]
    texts = dictionary.select(F.col("template_id").alias("_tid"), "template_text")
    lines = windows.select("*", F.posexplode_outer(ids).alias("_at", "_tid")).join(texts, "_tid", "left")
    line = F.when(F.col("_at").isNotNull(), F.struct("_at", snippet(F.col("_tid"), F.col("template_text")).alias("s")))
    return (
        lines.groupBy(*key)
        .agg(*[F.first(c).alias(c) for c in rest], F.sort_array(F.collect_list(line)).alias("_lines"))
        .select(*windows.columns, F.col("_lines.s").alias("templates_preview"))
    )


def active_keys(df: DataFrame, limit: int, key: str = "stream_key", order: list[str] = ("timestamp",)) -> DataFrame:
    """The ``limit`` most recently started keys: the first inserted leaves first.

    In a stream the bound is per-key state expiry instead, because a count over all keys would
    serialise them.
    """
    first_seen = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("n_events"))
    return first_seen.orderBy(F.desc("_first"), key).limit(limit).select(key, "n_events")
