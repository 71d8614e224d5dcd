"""Rolling count windows over a stream, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from logspark.streaming.state import KEY, Grouped, ends_of, stateful

CHUNK = 8192  # windows of an output frame

WINDOW_SCHEMA = T.StructType([
    T.StructField("stream_key", T.StringType()),
    T.StructField("emit_index", T.LongType()),
    T.StructField("sequence_id", T.StringType()),
    T.StructField("tokens", T.ArrayType(T.IntegerType())),
    T.StructField("timestamps", T.ArrayType(T.DoubleType())),
    T.StructField("label", T.IntegerType()),
])


def with_nulls(values: np.ndarray) -> list:
    """Lists of the rows of a matrix, with None for NaN."""
    gaps = np.isnan(values)
    return np.where(gaps, None, values.astype(object)).tolist() if gaps.any() else values.tolist()


class RollingWindows(Grouped):
    """Holds the last ``window`` events of each key; a key silent for ``ttl_ms`` is dropped.

    Events of one micro-batch are taken in time order; across micro-batches arrival order counts, as
    everywhere in a count window. ``maxFilesPerTrigger`` bounds the rows of a group held at once. ``values`` are
    further columns of doubles that come as one array each.
    """

    order = ["timestamp", "line_no"]

    def __init__(self, window: int, stride: int, ttl_ms: int | None, values: tuple[str, ...] = ()):
        self.window, self.stride, self.ttl_ms, self.values = window, stride, ttl_ms, values

    def step(self, batch, codes, old, old_codes, names) -> tuple[Iterator[pd.DataFrame], pd.DataFrame]:
        columns = ["token_id", "timestamp", "label", *self.values]
        new = pd.DataFrame({c: batch[c].astype(float).to_numpy(dtype=float, na_value=np.nan) for c in columns})
        before = np.zeros(len(names), np.int64)  # number of the first row of each key that is at hand
        fresh = np.ones(len(new), bool)
        if old is not None and len(old):
            first = ends_of(old_codes)[0]
            before[old_codes[first]] = old["pos"].to_numpy()[first]
            new, fresh = pd.concat([old[columns], new], ignore_index=True), np.append(np.zeros(len(old), bool), fresh)
            codes = np.append(old_codes, codes)
        place = np.argsort(codes, kind="stable")  # of a key the old rows come first
        new, fresh, codes = new.iloc[place], fresh[place], codes[place]
        begins, ends = ends_of(codes)
        pos = before[codes] + np.arange(len(codes)) - np.repeat(begins, ends - begins)
        due = np.flatnonzero(fresh & (pos + 1 >= self.window) & ((pos + 1 - self.window) % self.stride == 0))
        last = np.repeat(ends, ends - begins) - np.arange(len(codes)) <= self.window
        held = new[last].assign(pos=pos[last])
        held.insert(0, KEY, names[codes[last]])
        return self.cut(new, due, pos, names[codes]), held.reset_index(drop=True)

    def cut(self, rows: pd.DataFrame, due: np.ndarray, pos: np.ndarray, keys: np.ndarray) -> Iterator[pd.DataFrame]:
        data = {c: rows[c].to_numpy() for c in rows.columns}
        for some in (due[i : i + CHUNK] for i in range(0, len(due), CHUNK)):
            at = some[:, None] + np.arange(1 - self.window, 1)
            index, own = (pos[some] + 1 - self.window) // self.stride, keys[some]
            labels = np.where(np.isnan(data["label"][at]), -np.inf, data["label"][at]).max(axis=1)
            yield pd.DataFrame({
                KEY: own, "emit_index": index,
                "sequence_id": [f"{k}_w{i}" for k, i in zip(own, index.tolist(), strict=True)],
                "tokens": data["token_id"][at].astype(int).tolist(), "timestamps": data["timestamp"][at].tolist(),
                "label": pd.Series(np.where(np.isinf(labels), np.nan, labels)).astype("Int32"),
                **{v: with_nulls(data[v][at]) for v in self.values},
            })


def stream_windows(events: DataFrame, window: int = 50, stride: int = 10, ttl_ms: int | None = None) -> DataFrame:
    """Windows of a stream with ``stream_key, timestamp, line_no, token_id, label``."""
    narrow = events.select("stream_key", "timestamp", "line_no", "token_id", "label")
    return stateful(narrow, RollingWindows(window, stride, ttl_ms), WINDOW_SCHEMA)


def run_to_table(stream: DataFrame, path: str, schema: T.StructType, mode: str = "append") -> DataFrame:
    """Process what is available, write it as Parquet below ``path`` and read it back."""
    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        started = writer.format("parquet").outputMode("append").start(f"{path}/data")
    else:
        overwrite = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/data")
        started = writer.foreachBatch(overwrite).outputMode(mode).start()
    started.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/data")
