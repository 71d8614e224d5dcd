"""Alert cooldown over a stream and the alert outbox."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from logspark.operators.alerts import first_free
from logspark.sources.sinks import outbox_writer
from logspark.streaming.state import KEY, Grouped, ends_of, stateful

FLAG_SCHEMA = T.StructType([
    T.StructField("stream_key", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("fired", T.BooleanType()),
])


class Cooldown(Grouped):
    """Adds ``fired``: true unless the key fired less than ``seconds`` before, in event time; null means never."""

    def __init__(self, order: list[str], seconds: float, ttl_ms: int | None, columns: list[str]):
        self.order, self.seconds, self.ttl_ms, self.columns = order, seconds, ttl_ms, columns

    def step(self, batch, codes, old, old_codes, names) -> tuple[list[pd.DataFrame], pd.DataFrame]:
        lasts = np.full(len(names), np.nan)
        if old is not None:
            lasts[old_codes] = old["last"].to_numpy()
        times = batch[self.order[0]].to_numpy(dtype=float)
        fired = np.full(len(times), self.seconds <= 0)
        begins, ends = ends_of(codes)
        for code, begin, end in zip(codes[begins].tolist(), begins.tolist(), ends.tolist(), strict=True):
            at, last = begin, None if np.isnan(lasts[code]) else float(lasts[code])
            while self.seconds > 0 and (at := at + first_free(times[at:end], last, self.seconds)) < end:
                fired[at], last = True, float(times[at])  # each firing is one search
                lasts[code] = last
        whole = {f: "Int32" for f in ("label",) if f in self.columns}
        known = np.flatnonzero(~np.isnan(lasts))
        held = pd.DataFrame({KEY: names[known], "last": lasts[known]})
        return [batch.assign(fired=fired).astype(whole)[self.columns]], held


def stream_cooldown(gated: DataFrame, seconds: float = 60.0, ttl_ms: int | None = None) -> DataFrame:
    """Add ``fired`` to a stream of gated alerts with ``stream_key, timestamp, item_id``."""
    processor = Cooldown(["timestamp", "item_id"], seconds, ttl_ms, FLAG_SCHEMA.names)
    return stateful(gated.select("stream_key", "timestamp", "item_id"), processor, FLAG_SCHEMA)


def run_outbox(alerts: DataFrame, path: str, state: str) -> None:
    """Deliver the available alerts of a stream to the outbox."""
    alerts.writeStream.foreachBatch(outbox_writer(path)).option("checkpointLocation", state).trigger(
        availableNow=True
    ).start().awaitTermination()
