"""Keyed state of a stream, many keys per group.

A call of a Python processor and its reads and writes of state cost some milliseconds, many times the work on a usual
key. Keys are therefore dealt out by hash to a fixed number of groups; a call goes through the rows of all keys of its
group with array operations, and the group's state is one packed table, of which a key holds a bounded part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed for the life of a checkpoint.
GROUPS = 2048
KEY = "stream_key"


def use_rocksdb(spark) -> None:
    """Keep state in RocksDB: it lives outside the heap and is uploaded as changes to the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Grouped(StatefulProcessor):
    """Holds a table of state rows of all keys of a group; the rows of a key silent for ``ttl_ms`` are dropped.

    ``step`` gets the new rows by key and ``order``, the old state rows of their keys (those of a key together, as they
    were returned), of both the number of the key, and the names of the keys. It returns frames for the output and the
    new state rows of these keys.
    """

    order: list[str]
    ttl_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "rows binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        now = timer_values.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        codes, names = pd.factorize(batch[KEY], use_na_sentinel=False)
        names = np.where(pd.isna(names), None, np.asarray(names, dtype=object))
        place = np.argsort(codes, kind="stable")
        batch, codes = batch.iloc[place].reset_index(drop=True), codes[place]
        old = pa.ipc.open_stream(self.held.get()[0]).read_pandas() if self.held.exists() else None
        if old is not None and self.ttl_ms:
            old = old[old["_at"] + self.ttl_ms > now]
        rest, known, known_codes = None, None, np.zeros(0, int)
        if old is not None:
            known_codes = pd.Index(names, dtype=object).get_indexer(old[KEY])
            rest, known = old[known_codes < 0], old[known_codes >= 0].reset_index(drop=True)
            known_codes = known_codes[known_codes >= 0]
        out, new = self.step(batch, codes, known, known_codes, names)
        kept = new.assign(_at=now) if rest is None or rest.empty else pd.concat([rest, new.assign(_at=now)], ignore_index=True)
        table, sink = pa.RecordBatch.from_pandas(kept, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_batch(table)
        self.held.update((sink.getvalue().to_pybytes(),))
        yield from out

    def step(self, batch: pd.DataFrame, codes: np.ndarray, old: pd.DataFrame | None, old_codes: np.ndarray, names) -> tuple:
        raise NotImplementedError

    def close(self) -> None:
        pass


def ends_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal numbers begin and end."""
    begins = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return begins, np.append(begins[1:], len(codes))


def stateful(rows: DataFrame, processor: Grouped, schema: str | T.StructType) -> DataFrame:
    """The rows of a stream through ``processor``, in append mode."""
    use_rocksdb(rows.sparkSession)
    group = F.pmod(F.xxhash64(KEY), F.lit(GROUPS)).cast("int")
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return rows.withColumn("_group", group).groupBy("_group").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append",
        timeMode="processingTime" if processor.ttl_ms else "none",
    )
