"""The fitted flow: saving and loading, applying to tables and streams, a missing model, silent keys."""

import random

import pytest
from pyspark.sql import functions as F

from logspark import artefacts as af
from logspark.plans import online
from logspark.sources import readers as rd
from logspark.streaming import windows as st_windows

TEXTS = ["open", "read", "write", "close", "fail"]


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        text = rng.choice(TEXTS[:4]) if i < 450 else rng.choice([*TEXTS, "new text", None])
        rows.append((i, float(i // 3), f"svc-{rng.randrange(2)}", rng.choice(["a", "b", None]), text, rng.choice([0, 0, 1, None])))
    return spark.createDataFrame(
        rows, "line_no bigint, timestamp double, service string, session_id string, template_text string, label int"
    ).cache()


@pytest.fixture(scope="module")
def folder(spark, events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fit"))
    online.fit(events.where("line_no < 450"), path, 12, 5, percentile=60.0)
    return path


def as_rows(df):
    return sorted(map(tuple, df.select(*online.FLAGGED, "fired").collect()), key=repr)


def test_versions_are_whole_and_newest_counts(spark, tmp_path):
    path = str(tmp_path / "kept")
    assert af.load(spark, path) == ("", {}, {})
    one = af.save(spark, path, {"t": spark.range(3)}, {"a": 1})
    spark.range(5).write.parquet(f"{path}/unfinished/t")  # no manifest row: not a version
    two = af.save(spark, path, {"t": spark.range(4).selectExpr("id", "array(id) as many")}, {"a": 2})
    assert af.load(spark.newSession(), path).version == two and af.load(spark, path).params == {"a": 2}
    assert af.load(spark, path, one).tables["t"].count() == 3 and af.load(spark, path).tables["t"].columns == ["id", "many"]
    with pytest.raises(ValueError):
        af.load(spark, path, "missing")


def test_apply_does_not_depend_on_what_it_is_applied_to(spark, events, folder):
    model = af.load(spark.newSession(), folder)
    later = events.where("line_no >= 450")
    whole = online.apply(later, model, 30.0)
    one = later.where("service = 'svc-0' and session_id = 'a'")
    assert as_rows(online.apply(one, model, 30.0)) == [r for r in as_rows(whole) if r[0] == "svc-0:a"]
    assert online.apply(later.limit(0), model, 30.0).count() == 0
    counts = {r["fired"]: r["n"] for r in whole.groupBy("fired").agg(F.count("*").alias("n")).collect()}
    assert counts[True] and counts[False]


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_equals_table(spark, events, folder, tmp_path, parts):
    model = af.load(spark, folder)
    later = events.where("line_no >= 450")
    step = 450 // parts

    def run(upto):
        source = rd.stream_files(spark, str(tmp_path / "in"), later.schema, maxFilesPerTrigger=1)
        return st_windows.run_to_table(online.apply_stream(source, model, 30.0), str(tmp_path / "out"), stream_schema)

    stream_schema = online.apply(later, model, 30.0).schema
    for part in range(parts):
        rows = later.where((F.col("line_no") >= 450 + part * step) & (F.col("line_no") < 450 + (part + 1) * step))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if part == parts // 2:
            run(part)  # stopped here and started again from its checkpoint
    done = 450 + parts * step
    assert as_rows(run(parts)) == as_rows(online.apply(later.where(F.col("line_no") < done), model, 30.0))


def test_without_a_model_the_constant_counts(spark, events, tmp_path):
    none = af.load(spark, str(tmp_path / "nothing"))
    got = online.apply(events, none, 0.0, fallback_score=0.7, default_threshold=0.5, window=12, stride=5)
    assert {(r["risk_score"], r["fallback_reason"]) for r in got.collect()} == {(0.7, "no model")} and got.where("not fired").count() == 0
    assert online.apply(events, none, 0.0, fallback_score=0.2, default_threshold=0.5).count() == 0
