"""Null keys, open gaps, words beyond ASCII, chunks of several files, and forests that do not follow the table size."""

import pytest
from pyspark.sql import functions as F

from logspark.functions.text import tokenize
from logspark.operators import models, opsmetrics, ordering, sampling
from logspark.sources import readers, sinks


def test_words_beyond_ascii(spark):
    row = spark.createDataFrame([("[NUM] für die größe naïve_2 日本 x²",)], "t string").select(tokenize(F.col("t")).alias("w")).first()
    assert row["w"] == ["[NUM]", "für", "die", "größe", "naïve_2", "日本", "x²"]


def test_split_keeps_rows_without_label(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(40)], "id long, label int")
    rows = sampling.split_stratified(df, "id").collect()
    assert len(rows) == 40
    assert {r["split"] for r in rows if r["label"] is None} == {"train", "val", "test"}


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([("a", 0.0), (None, 0.0), (None, 7200.0)], "k string, t double")
    got = opsmetrics.increase(df, "t", ["k"], {"n": F.lit(1).cast("bigint")}, 3600, 3600).collect()
    assert {(r["k"], r["step_start"]): r["n"] for r in got} == {
        ("a", 0): 1, ("a", 3600): 0, ("a", 7200): 0, (None, 0): 1, (None, 3600): 0, (None, 7200): 1,
    }
    sums = ordering.running_sums(df.withColumn("n", F.lit(1)), ["k"], "t", ["n"]).collect()
    assert {(r["k"], r["t"]): r["cum_n"] for r in sums} == {("a", 0.0): 1, (None, 0.0): 1, (None, 7200.0): 2}


def test_stopped_stream_is_stalled(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 0.0), ("b", 9000.0)], "k string, t double")
    got = {(r["k"], r["stalled_from"], r["stalled_to"]) for r in opsmetrics.stalled(df, "t", ["k"], 7200, 3600).collect()}
    assert got == {("a", 10.0, 9000.0), ("b", 0.0, 9000.0)}


def test_chunks_do_not_span_files(spark):
    df = spark.createDataFrame([(f, i, "- x") for f in ("f1", "f2") for i in range(60)], "file string, line_no long, line string")
    sizes = readers.chunk_lines(df).groupBy("session_id").count().collect()
    assert sorted(r["count"] for r in sizes) == [10, 10, 50, 50]


def test_outbox_errors_are_told(spark, tmp_path):
    assert sinks.read_outbox(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):  # noqa: B017, PT011
        sinks.read_outbox(spark, "nosuchscheme://x/y").count()


def test_one_more_row_changes_only_trees_that_draw_it(spark):
    def nodes(n):
        df = spark.range(n).select(F.col("id").alias("row_id"), F.array(F.rand(1) * 0 + F.col("id") % 97, F.col("id") % 13).cast("array<double>").alias("x"))
        out = {}
        for r in models.iforest_fit(df, "row_id", "x", trees=20, sample_rows=16).collect():
            out.setdefault(r["tree_id"], []).append(tuple(r))
        return {t: sorted(map(repr, v)) for t, v in out.items()}

    small, more = nodes(640), nodes(641)
    assert sum(small[t] != more[t] for t in small) <= 4
