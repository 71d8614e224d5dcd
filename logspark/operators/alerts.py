"""Risk rows, alert gate, cooldown, alert projection and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.events import severity_by_ratio
from logspark.operators.ordering import rank_within, top_k
from logspark.session import materialise

SEGMENT_COOLDOWNS = 100


def decide(score: Column, threshold: Column, *, strict: bool = False) -> Column:
    """Anomaly flag: ``score >= threshold``, or ``>`` when strict."""
    return score > threshold if strict else score >= threshold


def risk_results(windows: DataFrame, model: str, score: Column, threshold: Column, *, strict: bool = False) -> DataFrame:
    """Score rounded to 6 digits, flag, and meta of each window; the flag uses the unrounded score."""
    return windows.withColumns({
        "_raw": score,
        "threshold": threshold,
    }).withColumns({
        "timestamp": F.coalesce(F.element_at("timestamps", -1), F.lit(0.0)),
        "model": F.lit(model),
        "risk_score": F.round("_raw", 6),
        "is_anomaly": decide(F.col("_raw"), F.col("threshold"), strict=strict),
        "window_size": F.size("tokens"),
        "emit_number": F.col("emit_index") + 1,
    }).drop("_raw")


def alert_gate(risks: DataFrame, min_score: float = 0.0, min_events: int = 0) -> DataFrame:
    """Anomalies that pass the policy: minimum score and minimum window length, each off when 0."""
    keep = F.col("is_anomaly")
    if min_score > 0:
        keep = keep & (F.col("risk_score") >= min_score)
    if min_events > 0:
        keep = keep & (F.col("window_size") >= min_events)
    return risks.where(keep)


def next_firings(times: np.ndarray, seconds: float) -> np.ndarray:
    """For each of the ascending times the number of the first one at least ``seconds`` later; their count if none."""
    far = np.searchsorted(times, times + seconds, side="left")
    while True:  # the sum is rounded, the rule is about differences: move by single rows until it holds
        early = (far > 0) & (times[np.maximum(far - 1, 0)] - times >= seconds)
        late = (far < len(times)) & (times[np.minimum(far, len(times) - 1)] - times < seconds)
        if not (early.any() or late.any()):
            return far
        far = far - early + late


def first_free(times: np.ndarray, last: float | None, seconds: float) -> int:
    """Number of the first of the ascending times at which a key may fire that fired at ``last``; one search."""
    if last is None:
        return 0
    at = int(np.searchsorted(times, last + seconds, side="left"))
    while at > 0 and times[at - 1] - last >= seconds:  # the sum is rounded, the rule is about differences
        at -= 1
    while at < len(times) and times[at] - last < seconds:
        at += 1
    return at


def cooldown(df: DataFrame, key: str, order: list[str], seconds: float, segment: int = SEGMENT_COOLDOWNS) -> DataFrame:
    """Add ``fired``: true unless the same key fired less than ``seconds`` before.

    ``order`` is a unique order whose first column is the time in seconds. Only the first row of a key and time can
    fire, so the work is done on distinct times, without the other columns. Each key is cut in segments of
    ``segment`` cooldowns, and a segment holds its times in order as one packed column. A pointer from each time to
    the next one it allows, followed by doubling, tells for every way to enter a segment (a first firing inside its
    first cooldown) the last firing it leads to; ways that end alike are one entry. A walk over these short tables
    gives what each segment of a key starts with, and a search per firing marks the times. All this is linear in
    the distinct times, up to the logarithm of a segment. Rows without a time do not fire.
    """
    if seconds <= 0:
        return df.withColumn("fired", F.lit(True))
    time, rest, length = order[0], order[1:], float(seconds) * segment
    row = F.struct(*rest) if rest else F.lit(0)
    kind = df.schema[key].dataType.simpleString()
    times = df.groupBy(F.col(key).alias("_key"), F.col(time).cast("double").alias("_t")).agg(F.min(row).alias("_first")).where("_t is not null")
    times = materialise(times, "cooldown-times")

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, ends_of = [], batch.column(2).offsets.to_numpy()
            flat, ends_of = batch.column(2).flatten().to_numpy(), ends_of - ends_of[0]
            for seg, begin, end in zip(batch.column(1).to_pylist(), ends_of[:-1], ends_of[1:], strict=True):
                t = flat[begin:end]
                far = next_firings(t, seconds)
                last = np.where(far < len(t), far, np.arange(len(t)))
                while (last[last] != last).any():
                    last = last[last]
                ways = min(len(t), int(np.searchsorted(t, seg * length + seconds * 1.001, side="left")) + 1)
                ends = t[last[:ways]]
                kept = np.append(ends[1:] != ends[:-1], True)  # of the ways that end alike the latest
                packed.append([x.tobytes() for x in (t, t[:ways][kept], ends[kept])])
            columns = [pa.array([row[i] for row in packed], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["_key", "_seg", "_times", "_ways", "_ends"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, segs, found = [], [], []
            for i, parts in enumerate(batch.column(1).to_pylist()):
                last = None
                for part in parts:
                    rows.append(i)
                    segs.append(part["_seg"])
                    found.append(last)
                    at, ends = first_free(np.frombuffer(part["_ways"]), last, seconds), np.frombuffer(part["_ends"])
                    last = float(ends[at]) if at < len(ends) else last
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(segs, pa.int64()), pa.array(found, pa.float64())], ["_key", "_seg", "_entry"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, fired = [], []
            for i, (packed, last) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                t, at = np.frombuffer(packed), 0
                while (at := at + first_free(t[at:], last, seconds)) < len(t):
                    last = float(t[at])
                    rows.append(i)
                    fired.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(fired, pa.float64())], ["_key", "_t"])

    cut = times.select("_key", "_t", F.floor(F.col("_t") / length).alias("_seg"))
    # many keys and segments go through Python in one batch: a call per key would cost more than the work
    listed = cut.groupBy("_key", "_seg").agg(F.sort_array(F.collect_list("_t")).alias("_list"))
    segments = listed.mapInArrow(tabulate, f"_key {kind}, _seg long, _times binary, _ways binary, _ends binary")
    segments = materialise(segments, "cooldown-segments")
    listed = segments.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_seg", "_ways", "_ends"))).alias("_list"))
    entries = listed.mapInArrow(walk, f"_key {kind}, _seg long, _entry double")
    entries = entries.select(F.col("_key").alias("_owner"), F.col("_seg").alias("_part"), "_entry")
    begun = segments.join(entries, F.col("_key").eqNullSafe(F.col("_owner")) & (F.col("_seg") == F.col("_part")))
    fired = begun.select("_key", "_times", "_entry").mapInArrow(mark, f"_key {kind}, _t double")
    fired = fired.select(F.col("_key").alias("_owner"), F.col("_t").alias("_at"))
    fired = times.join(fired, F.col("_key").eqNullSafe(F.col("_owner")) & (F.col("_t") == F.col("_at"))).select("_key", "_t", "_first")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col(time).cast("double") == F.col("_t")) & row.eqNullSafe(F.col("_first"))
    return df.join(fired, same, "left").select(*df.columns, F.col("_t").isNotNull().alias("fired"))


def alerts(fired: DataFrame, cooldown_id: list[str] = ("stream_key", "timestamp", "emit_index")) -> DataFrame:
    """Alert rows of fired risks: severity, service, evidence, meta and an id derived from the risk.

    ``templates_preview`` is taken over where the risks carry it.
    """
    have = "templates_preview" in fired.columns
    evidence = F.struct(
        (F.col("templates_preview") if have else F.array().cast("array<string>")).alias("templates_preview"),
        F.size("evidence_window.tokens").alias("token_count"),
        F.col("evidence_window.window_start_ts").alias("start_ts"),
        F.col("evidence_window.window_end_ts").alias("end_ts"),
    )
    meta = F.struct("stream_key", "is_anomaly", "window_size", "label", F.col("emit_number").alias("emit_index"))
    return fired.select(
        F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cooldown_id]), 256).alias("alert_id"),
        severity_by_ratio(F.col("risk_score"), F.col("threshold")).alias("severity"),
        F.element_at(F.split("stream_key", ":"), 1).alias("service"),
        F.col("risk_score").alias("score"),
        "timestamp",
        evidence.alias("evidence_window"),
        F.col("model").alias("model_name"),
        "threshold",
        meta.alias("meta"),
    )


def suppressed_counts(flagged: DataFrame, key: str) -> DataFrame:
    """Fired and suppressed alerts per key."""
    return flagged.groupBy(key).agg(
        F.count_if("fired").alias("fired"), F.count_if(~F.col("fired")).alias("suppressed")
    )


def recent_alerts(fired: DataFrame, order: list[Column], limit: int = 50) -> DataFrame:
    """Newest ``limit`` alerts."""
    return top_k(fired, order, limit)


def recent_alerts_per_key(fired: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """Newest ``limit`` alerts of each key."""
    return rank_within(fired, [key], order, limit).drop("rank")


def alert_message(service: Column, severity: Column, score: Column, confidence: Column) -> Column:
    """Alert text with score to four digits and confidence in per cent."""
    # Fixed value: wording of the alert text.
    return F.format_string(
        "Anomaly detected in service '%s' — severity=%s score=%.4f confidence=%.2f%%",
        service, F.upper(severity), score, confidence * 100,
    )


def run_counters(events: DataFrame, risks: DataFrame) -> DataFrame:
    """Events, windows, anomalies and live streams in one row."""
    seen = events.agg(F.count(F.lit(1)).alias("events_total"), F.count_distinct("stream_key").alias("active_streams"))
    emitted = risks.agg(
        F.struct(F.count(F.lit(1)).alias("w"), F.count_if("is_anomaly").alias("a")).alias("s")
    ).scalar()
    return seen.select(
        "events_total",
        emitted.getField("w").alias("windows_total"),
        emitted.getField("a").alias("anomalies_total"),
        "active_streams",
    )


def alerts_by_severity(df: DataFrame) -> DataFrame:
    """Alerts per severity."""
    return df.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
