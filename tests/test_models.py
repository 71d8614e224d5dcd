import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.operators import models as md
from logspark.operators import vectors as vc
from logspark.operators.evaluate import roc_auc


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 1, 4).tolist(), 0) for i in range(600)] + [(600 + i, rng.normal(6, 1, 4).tolist(), 1) for i in range(12)]
    return spark.createDataFrame(rows, "row_id bigint, features array<double>, label int").cache()


def test_iforest_ranks_planted_outliers(planted):
    nodes = md.iforest_fit(planted, "row_id", "features", trees=60)
    scored = md.iforest_score(planted, nodes, "features")
    assert roc_auc(scored.select("score", "label")).first()[0] > 0.95
    ends = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 < ends[0] < ends[1] <= 1
    sizes = nodes.where("node = 1").agg(F.max("size"), F.count("size")).first()
    assert sizes[0] <= md.SAMPLE_ROWS and sizes[1] == 60


def test_iforest_is_deterministic(planted):
    a, b = (md.iforest_fit(planted, "row_id", "features", trees=10).orderBy("tree_id", "node").collect() for _ in range(2))
    assert a == b


def test_iforest_sparse_draw(spark):
    big = spark.range(40_000).select("id", F.array(F.rand(1), F.rand(2)).alias("features"))
    roots = md.iforest_fit(big, "id", "features", trees=20).where("node = 1").collect()
    assert len(roots) == 20 and all(200 < r["size"] <= 256 for r in roots)


def test_path_correction():
    assert md.path_correction(np.array([0, 1, 2])).tolist() == [0.0, 0.0, 1.0]
    assert md.path_correction(256) == pytest.approx(10.2448, abs=1e-3)


def test_reconstruction_error(planted):
    model = vc.fit_reconstruction(planted.where("label = 0"), "features", 2)
    rows = vc.reconstruction(planted, model, "features").collect()
    x = np.array([r.features for r in rows])
    pc = model.pc.toArray()
    want = ((x - x @ pc @ pc.T) ** 2).mean(axis=1)
    assert np.allclose([r.error for r in rows], want) and min(r.error for r in rows) >= 0


def test_supervised_and_severity(planted):
    model = md.fit_logreg(planted)
    scored = md.score_supervised(planted, model, "score")
    assert roc_auc(scored.select("score", "label")).first()[0] > 0.98
    severity = planted.withColumn("severity", (F.col("row_id") % 3).cast("int"))
    out = md.classify_severity(severity, md.fit_severity(severity, "features", 4), "features").collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 and r.confidence == max(r.probabilities) for r in out)


def test_mean_pool_ignores_unknown_tokens(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "token int, vector array<double>")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 9), ("b", 9)], "s string, tok int")
    got = {r.s: r.vector for r in vc.mean_pool(df, ["s"], "tok", vectors, 2).collect()}
    assert got == {"a": [0.5, 1.0], "b": [0.0, 0.0]}


def test_window_contexts_stay_in_place(spark):
    """Contexts as the definition has them, without a shuffle; ids without a vector count as zeros."""
    rng = np.random.default_rng(3)
    table = {i: rng.normal(size=4).tolist() for i in range(1, 6)}
    ids = [[int(v) for v in rng.integers(0, 9, 10)] for _ in range(50)] + [[], [2, None, 3]]
    vectors = spark.createDataFrame(list(table.items()), "template_id int, vector array<double>")
    windows = spark.createDataFrame(list(enumerate(ids)), "w int, template_id array<int>").repartition(3)
    found = vc.window_contexts(windows, "template_id", vectors, 4)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # that of the test
    for row in found.collect():
        own = ids[row["w"]]
        total = max(len(own) * (len(own) + 1) / 2, 1)
        want = sum(((i + 1) * np.array(table.get(v, [0.0] * 4)) for i, v in enumerate(own)), np.zeros(4)) / total
        assert np.allclose(row["vector"], want)
    assert all(not any(r["vector"]) for r in vc.window_contexts(windows, "template_id", vectors.limit(0), 4).collect())


def test_training_tasks_follow_large_corpora():
    assert [vc.training_tasks(n) for n in (0, 1_000_000, 16_000_000, 36_000_000)] == [4, 4, 4, 9]
