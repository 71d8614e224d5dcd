"""Batch and streaming forms must agree, in one micro-batch and in several."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.operators import alerts as al
from logspark.operators import windows as wn
from logspark.sources import readers as rd
from logspark.sources import sinks as sk
from logspark.streaming import alerts as st_alerts
from logspark.streaming import metrics as st_metrics
from logspark.streaming import state as st_state
from logspark.streaming import windows as st_windows


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(11)
    rows = [(f"svc:{rng.randrange(6)}", float(i // 2), i, rng.randrange(2, 9), rng.choice([0, 1, None])) for i in range(600)]
    return spark.createDataFrame(rows, "stream_key string, timestamp double, line_no bigint, token_id int, label int").cache()


def as_stream(spark, df, path, parts):
    for i in range(parts):
        df.where(F.floor(F.col("line_no") / (600 / parts)) == i).coalesce(1).write.mode("append").parquet(str(path))
    return rd.stream_files(spark, str(path), df.schema, maxFilesPerTrigger=1)


@pytest.mark.parametrize("parts", [1, 4])
def test_windows_parity(spark, events, tmp_path, parts):
    stream = st_windows.stream_windows(as_stream(spark, events, tmp_path / "in", parts), 20, 7)
    got = st_windows.run_to_table(stream, str(tmp_path / "out"), stream.schema)
    want = wn.rolling_windows(events, ["timestamp", "line_no"], 20, 7).select(*got.columns)
    key = lambda r: r.sequence_id
    assert sorted(map(tuple, sorted(got.collect(), key=key))) == sorted(map(tuple, sorted(want.collect(), key=key)))


@pytest.mark.parametrize("parts", [1, 4])
def test_cooldown_parity(spark, events, tmp_path, parts):
    items = events.withColumnRenamed("line_no", "item_id")
    source = as_stream(spark, events, tmp_path / "in", parts).withColumnRenamed("line_no", "item_id")
    stream = st_alerts.stream_cooldown(source, 25.0)
    got = st_windows.run_to_table(stream, str(tmp_path / "out"), stream.schema)
    want = al.cooldown(items.select("stream_key", "timestamp", "item_id"), "stream_key", ["timestamp", "item_id"], 25.0)
    assert sorted(map(tuple, got.select("stream_key", "item_id", "fired").collect())) == sorted(
        map(tuple, want.select("stream_key", "item_id", "fired").collect()))


def test_increase_closes_windows_behind_the_watermark(spark, events, tmp_path):
    timed = as_stream(spark, events, tmp_path / "in", 4).withColumn("at", F.timestamp_seconds("timestamp"))
    stream = st_metrics.stream_increase(timed, "at", [], {"n": F.lit(1)}, "60 seconds", "60 seconds", "0 seconds")
    rows = st_windows.run_to_table(stream, str(tmp_path / "out"), stream.schema).orderBy("window_start").collect()
    assert [r.n for r in rows] == [120, 120, 120, 120]


def test_outbox_is_written_once_per_alert(spark, tmp_path):
    alerts = spark.createDataFrame([("a1", "high", 1.5), ("a2", "low", 0.5)], "alert_id string, severity string, score double")
    alerts.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        source = rd.stream_files(spark, str(tmp_path / "in"), alerts.schema)
        st_alerts.run_outbox(source, str(tmp_path / "box"), str(tmp_path / "state"))
    rows = sk.read_outbox(spark, str(tmp_path / "box")).collect()
    assert sorted(r.alert_id for r in rows) == ["a1", "a2"]
    assert json.loads(next(r.document for r in rows if r.alert_id == "a1"))["severity"] == "high"
    assert sk.read_outbox(spark, str(tmp_path / "empty")).count() == 0


def test_event_contracts(spark):
    raw = spark.createDataFrame([("svc", 4, "x")], "service string, token_id int, extra string")
    assert tuple(rd.token_events(raw).first()) == (0.0, "svc", "", 4, None)
    line = rd.raw_events(spark.createDataFrame([("msg",)], "raw_log string")).first()
    assert (line.raw_log, line.service, line.session_id) == ("msg", "default", "") and line.timestamp > 1.6e9


def test_text_line_numbers(spark, tmp_path):
    lines = [f"line {i} blk_{i}" if i % 2 else f"- line {i}" for i in range(5000)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = rd.text_lines(spark, str(tmp_path / "a.log"))
        assert [r.line for r in got.orderBy("line_no").collect()] == lines
        assert rd.block_lines(got).count() == 2500
        chunks = rd.chunk_lines(got)
        assert chunks.select("session_id").distinct().count() == 100
        assert chunks.agg(F.sum("label")).first()[0] == 2500
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_state_is_held_by_group_not_by_key(spark, tmp_path, monkeypatch):
    """Hundreds of keys, few calls: the state has a row per group, and every key its own windows over two micro-batches."""
    monkeypatch.setattr(st_state, "GROUPS", 8)
    rows = [(None if k == 7 else f"k{k}", float(i), i, (i * 7 + k) % 5 + 2, None if i % 3 else 1) for k in range(300) for i in range(9)]
    schema = "stream_key string, timestamp double, line_no bigint, token_id int, label int"
    for part in range(2):
        some = [r for r in rows if (r[2] >= 5) == bool(part)]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = rd.stream_files(spark, str(tmp_path / "in"), T._parse_datatype_string(schema), maxFilesPerTrigger=1)
    query = st_windows.stream_windows(source, 4, 2).writeStream.format("memory").queryName("grouped").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 8
    got = sorted((str(r["stream_key"]), r["emit_index"], r["tokens"], r["timestamps"], r["label"]) for r in spark.table("grouped").collect())
    own = lambda k, s: [(i * 7 + k) % 5 + 2 for i in range(s, s + 4)]
    assert got == sorted(
        ("None" if k == 7 else f"k{k}", s // 2, own(k, s), [float(i) for i in range(s, s + 4)], 1) for k in range(300) for s in (0, 2, 4)
    )
