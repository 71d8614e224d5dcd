"""Keyed state of the online alert flow: the last event, the last window, the last firing.

Each operator sorts the rows of a key in a micro-batch by its order and goes through them once; what it holds of a key
between micro-batches is bounded by the window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from logspark.streaming.alerts import Cooldown
from logspark.streaming.state import KEY, Grouped, ends_of, stateful
from logspark.streaming.windows import WINDOW_SCHEMA, RollingWindows

STEPS = "stream_key string, timestamp double, line_no bigint, token int, template_id int, token_id int, label int"


class Steps(Grouped):
    """Adds the template of the event before, null for the first of a key."""

    order = ["timestamp", "line_no"]

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def step(self, batch, codes, old, old_codes, names) -> tuple[list[pd.DataFrame], pd.DataFrame]:
        begins, ends = ends_of(codes)
        own = batch["template_id"].to_numpy(dtype=float)
        before = np.full(len(names), np.nan)
        if old is not None:
            before[old_codes] = old["template_id"].to_numpy(dtype=float)
        token = np.append(np.nan, own[:-1])
        token[begins] = before[codes[begins]]
        held = pd.DataFrame({KEY: names[codes[begins]], "template_id": own[ends - 1]})
        out = batch.assign(token=pd.Series(token).astype("Int32")).astype({"label": "Int32"})
        return [out[["stream_key", "timestamp", "line_no", "token", "template_id", "token_id", "label"]]], held


def stream_steps(tokens: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Events of a stream with ``token``, the template before."""
    return stateful(tokens, Steps(ttl_ms), STEPS)


def stream_scored_windows(steps: DataFrame, window: int, stride: int, ttl_ms: int | None = None) -> DataFrame:
    """Rolling windows of a stream of steps with ``nll``, the surprise of the step into each event."""
    narrow = steps.select("stream_key", "timestamp", "line_no", "token_id", "label", "nll")
    schema = T.StructType([*WINDOW_SCHEMA.fields, T.StructField("nll", T.ArrayType(T.DoubleType()))])
    return stateful(narrow, RollingWindows(window, stride, ttl_ms, ("nll",)), schema)


def stream_fired(gated: DataFrame, seconds: float, ttl_ms: int | None = None) -> DataFrame:
    """Gated alerts of a stream with ``fired``."""
    schema = T.StructType([*gated.schema.fields, T.StructField("fired", T.BooleanType())])
    return stateful(gated, Cooldown(["timestamp", "emit_index"], seconds, ttl_ms, schema.names), schema)
