"""Sessions and sequences: labels, ordered token arrays, windows, splits by time, phases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.functions.events import stream_key
from logspark.operators.ordering import TARGET_ROWS, count_windows, rank_boundaries, value_buckets, with_position

CHUNK_TOKENS = 10_000


def label_sessions(df: DataFrame, truth: DataFrame) -> DataFrame:
    """Session label from a ``session_id, label`` table, 0 for a session it does not name."""
    known = truth.select("session_id", F.col("label").alias("_label"))
    return df.drop("label").join(known, "session_id", "left").withColumn(
        "label", F.coalesce("_label", F.lit(0))
    ).drop("_label")


def union_sources(*frames: DataFrame) -> DataFrame:
    """Rows of all sources; columns match by name, absent ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def session_chunks(
    df: DataFrame, keys: list[str], order: list[str], token: str, chunk: int = CHUNK_TOKENS,
    *, target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """``keys, part, tokens``: ordered tokens of each key in arrays of at most ``chunk``.

    A key up to ``chunk`` tokens is one row with ``part`` 0; a longer one continues in further rows, so
    no array and no task grows with a hot key.
    """
    placed = with_position(df.select(*keys, *order, token), keys, order, target_rows=target_rows)
    part = F.floor(F.col("pos") / chunk).alias("part")
    packed = placed.groupBy(*keys, part).agg(
        F.sort_array(F.collect_list(F.struct("pos", F.col(token).alias("token")))).alias("_rows")
    )
    return packed.select(*keys, "part", F.col("_rows.token").alias("tokens"))


def session_summary_columns(df: DataFrame, order: list[str]) -> DataFrame:
    """Per session: dataset of the first row, highest label, length, distinct templates.

    Aggregated first per (session, template), so a hot session is combined before it is shuffled.
    """
    per_token = df.groupBy("session_id", "template_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("label").alias("_label"),
        F.min(F.struct(*order, "service")).alias("_first"),
    )
    return per_token.groupBy("session_id").agg(
        F.min("_first").getField("service").alias("dataset"),
        F.max("_label").alias("label"),
        F.sum("_n").alias("sequence_length"),
        F.count(F.lit(1)).alias("unique_template_count"),
    )


def session_sequences(df: DataFrame, order: list[str], chunk: int = CHUNK_TOKENS) -> DataFrame:
    """Session summary with the ordered template ids, in parts of at most ``chunk`` ids."""
    parts = session_chunks(df, ["session_id"], order, "template_id", chunk)
    return session_summary_columns(df, order).join(parts, "session_id")


def parse_sequences(df: DataFrame, column: str = "ordered_template_sequence") -> DataFrame:
    """Decode a comma-separated id list to ``tokens``; null or blank text gives an empty array."""
    parts = F.filter(F.split(F.coalesce(column, F.lit("")), ","), lambda p: F.trim(p) != "")
    return df.withColumn("tokens", F.transform(parts, lambda p: F.trim(p).cast("int")))


def sliding_sequences(
    df: DataFrame, order: list[str], window: int = 50, stride: int = 10, keys: list[str] = (), **kw
) -> DataFrame:
    """Count windows named by their start; the label is the highest inside.

    A key with fewer rows than the window gives its single short window.
    """
    values = ["token_id", "timestamp", "label"]
    cut = count_windows(df, list(keys), order, values, window, stride, keep_short=True, **kw)
    return cut.select(
        *keys,
        F.concat(F.lit("window_"), F.col("start").cast("string")).alias("sequence_id"),
        F.col("rows.token_id").alias("tokens"),
        F.col("rows.timestamp").alias("timestamps"),
        F.array_max("rows.label").alias("label"),
    )


def embedding_windows(
    df: DataFrame, keys: list[str], order: list[str], window: int, stride: int,
    vector: str = "embedding", label: str | None = "label", **kw,
) -> DataFrame:
    """Full windows of vectors; label is the highest inside, or 0 when there are no labels."""
    values = [vector] + ([label] if label else [])
    cut = count_windows(df, keys, order, values, window, stride, **kw)
    flag = F.array_max(f"rows.{label}") if label else F.lit(0)
    return cut.select(*keys, "start", F.col(f"rows.{vector}").alias("vectors"), flag.alias("label"))


def window_label_counts(windows: DataFrame) -> DataFrame:
    """Number of normal and anomalous windows."""
    return windows.agg(
        F.count_if(F.col("label") == 0).alias("normal"), F.count_if(F.col("label") != 0).alias("anomaly")
    )


def session_windows(df: DataFrame, order: list[str], window: int, token: str = "token_id", **kw) -> DataFrame:
    """All windows with stride 1 of each session; sessions shorter than the window give none."""
    cut = count_windows(df, ["session_id"], order, [token], window, 1, **kw)
    return cut.select("session_id", "start", F.col(f"rows.{token}").alias("tokens"))


def thinned_windows(
    df: DataFrame, order: list[str], window: int, target: int = 10_000, token: str = "token_id", **kw
) -> DataFrame:
    """Windows over the whole frame with the stride that leaves about ``target`` of them."""
    stride = max(1, (df.count() - window) // target)
    cut = count_windows(df, [], order, [token], window, stride, **kw)
    return cut.select("start", F.lit(stride).alias("stride"), F.col(f"rows.{token}").alias("tokens"))


def token_corpus(sequences: DataFrame, sessions: DataFrame, families: DataFrame, min_events: int = 3) -> DataFrame:
    """Training sentences of three sources: given sequences, sessions with enough events, families."""
    text = lambda c: F.col(c).cast("array<string>").alias("tokens")
    return (
        sequences.where(F.size("tokens") > 0).select(F.lit("sequences").alias("source"), text("tokens"))
        .unionByName(
            sessions.where((F.size("tokens") >= min_events) | (F.col("part") > 0))
            .select(F.lit("sessions").alias("source"), text("tokens"))
        )
        .unionByName(families.select(F.lit("families").alias("source"), text("tokens")))
    )


def first_n_events(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Earliest ``n`` rows."""
    return df.orderBy(*order).limit(n)


def select_sessions(
    events: DataFrame, truth: DataFrame, window: int, max_sessions: int, session: str = "session_id"
) -> DataFrame:
    """Up to ``max_sessions`` labelled sessions with at least ``window`` events, half of them anomalous.

    What one half cannot supply is filled from the rest, in session order. Each step is a top-k or an
    anti join, so the driver and single tasks see at most ``max_sessions`` rows.
    """
    long_enough = events.groupBy(session).count().where(F.col("count") >= window)
    eligible = truth.join(long_enough, session, "left_semi").select(session, "label")
    half = max_sessions // 2
    anomalous = eligible.where(F.col("label") == 1).orderBy(session).limit(half)
    normal = eligible.where(F.col("label") == 0).orderBy(session).limit(half)
    chosen = anomalous.unionByName(normal).withColumn("_tier", F.lit(0))
    rest = eligible.join(chosen, session, "left_anti").orderBy(session).limit(max_sessions)
    return (
        chosen.unionByName(rest.withColumn("_tier", F.lit(1)))
        .orderBy("_tier", session).limit(max_sessions).drop("_tier")
    )


def keep_sessions(events: DataFrame, sessions: DataFrame, session: str = "session_id") -> DataFrame:
    """Events of the chosen sessions."""
    return events.join(sessions, session, "left_semi")


def split_by_time(df: DataFrame, order: list[str], val_ratio: float = 0.1, test_ratio: float = 0.1) -> DataFrame:
    """Add ``split``: the first part of the global order is train, then val, then test.

    Only the two rows at the borders are searched; every row is then compared with them in place.
    """
    n = F.count(F.lit(1))
    n_test = F.greatest(F.lit(1), F.bround(n * F.lit(test_ratio)).cast("bigint"))
    n_val = F.greatest(F.lit(1), F.bround(n * F.lit(val_ratio)).cast("bigint"))
    ranks = df.agg((n - n_val - n_test).alias("_val"), (n - n_test).alias("_test"))
    columns = [F.col(c) for c in order]
    cut = rank_boundaries(df, [], value_buckets(df, order[0]), columns, ranks, ["_val", "_test"])
    border = cut.select(F.struct("_val", "_test")).scalar()
    here = F.struct(*columns)
    split = F.when(here < border.getField("_val"), "train").when(here < border.getField("_test"), "val").otherwise("test")
    return df.withColumn("split", split)


def phase_labels(
    df: DataFrame, keys: list[str], order: list[str], normal: float = 0.6, degradation: float = 0.3,
    session_rows: int = 50, **kw,
) -> DataFrame:
    """Phase, progress and label of each row by its place in its scenario."""
    placed = with_position(df, keys, order, sizes=True, **kw)
    t, n = F.col("pos"), F.col("key_rows")
    n_normal = F.floor(n * F.lit(normal))
    n_deg = F.floor(n * F.lit(degradation))
    phase = F.when(t < n_normal, "normal").when(t < n_normal + n_deg, "degradation").otherwise("failure")
    progress = F.least(F.lit(1.0), (t - n_normal) / F.greatest(n_deg, F.lit(1)))
    return placed.select(
        *df.columns, "pos", phase.alias("phase"),
        F.greatest(F.lit(0.0), progress).alias("progress"),
        (phase != "normal").cast("int").alias("phase_label"),
        F.concat(F.concat_ws("/", *keys), F.lit("_s"), F.floor(t / session_rows).cast("string")).alias("phase_session"),
    )


def keyed(df: DataFrame) -> DataFrame:
    """Add the stream key of service and session."""
    return df.withColumn("stream_key", stream_key(F.col("service"), F.col("session_id")))
