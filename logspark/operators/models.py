"""Isolation forest, supervised classifiers, severity classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.session import materialise, small_table

SAMPLE_ROWS = 256  # rows per tree, the published default of the method
NODE_SCHEMA = "tree_id int, node int, feature int, split double, size int"


def path_correction(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows (Liu, Ting and Zhou, 2008)."""
    n = np.asarray(n, dtype=float)
    big = np.where(n > 2, n, 3.0)
    long = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(rows: np.ndarray, rng: np.random.Generator, height: int) -> list[tuple[int, int, float, int]]:
    """Nodes ``(node, feature, split, size)`` of one tree, heap-numbered; feature -1 marks a leaf."""
    nodes, todo = [], [(1, rows)]
    while todo:
        node, part = todo.pop()
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else []
        if len(spread) == 0 or node >= 2**height:
            nodes.append((node, -1, 0.0, len(part)))
            continue
        feature = int(rng.choice(spread))
        split = float(rng.uniform(part[:, feature].min(), part[:, feature].max()))
        left = part[:, feature] < split
        nodes.append((node, feature, split, len(part)))
        todo += [(2 * node, part[left]), (2 * node + 1, part[~left])]
    return nodes


def iforest_fit(
    df: DataFrame, row_id: str, features: str, trees: int = 300, seed: int = 42, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Node table of an isolation forest.

    Every row joins tree ``t`` with the same small probability by hash, and the tree keeps its
    ``sample_rows`` lowest hashes: a group never exceeds a few times that, whatever the data. Trees are
    grown in parallel, one task group per tree.
    """
    total = df.count()
    # twice what a tree keeps: the rate only spares work, the lowest hashes are the same for every table size
    limit = int(min(1.0, 2.0 * sample_rows / max(total, 1)) * (1 << 62))
    draw = lambda t: F.xxhash64(F.col(row_id), t, F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1))
    x = F.col(features).cast("array<double>").alias("x")
    trees_of = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree_id"), draw(t).alias("h")))
    drawn = df.select(x, F.col(row_id).cast("string").alias("row"), F.inline(F.filter(trees_of, lambda d: d["h"] < limit)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree_id"].iloc[0])
        part = np.vstack(pdf.sort_values(["h", "row"], kind="stable")["x"].to_numpy())[:sample_rows]
        height = int(np.ceil(np.log2(max(min(sample_rows, len(part)), 2))))
        nodes = pd.DataFrame(_grow(part, np.random.default_rng([seed, tree]), height), columns=["node", "feature", "split", "size"])
        return nodes.assign(tree_id=tree)[["tree_id", "node", "feature", "split", "size"]]

    return materialise(drawn.groupBy("tree_id").applyInPandas(grow, NODE_SCHEMA), "iforest")


def iforest_score(df: DataFrame, nodes: DataFrame, features: str) -> DataFrame:
    """Add ``score`` in (0, 1], higher is more anomalous.

    The node table has at most ``trees * 2 * SAMPLE_ROWS`` rows, a bound set by the fit, so it is sent
    to every task; rows are scored in Arrow batches where they lie.
    """
    table = nodes.toPandas()
    width = int(table["node"].max()) + 1
    n_trees = int(table["tree_id"].max()) + 1
    feature = np.full((n_trees, width), -1, dtype=np.int32)
    split = np.zeros((n_trees, width))
    size = np.zeros((n_trees, width))
    at = (table["tree_id"].to_numpy(), table["node"].to_numpy())
    feature[at], split[at], size[at] = table["feature"], table["split"], table["size"]
    sampled = float(size[:, 1].mean())
    shared = df.sparkSession.sparkContext.broadcast((feature, split, path_correction(size), float(path_correction(sampled))))
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feature, split, correction, normal = shared.value
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.vstack(pdf[features].to_numpy()).astype(float)
            rows, depth = np.arange(len(x)), np.zeros(len(x))
            for tree in range(len(feature)):
                node = np.ones(len(x), dtype=np.int64)
                inner = feature[tree, node] >= 0
                while inner.any():
                    f = feature[tree, node[inner]]
                    right = x[rows[inner], f] >= split[tree, node[inner]]
                    node[inner] = 2 * node[inner] + right
                    inner = feature[tree, node] >= 0
                depth += np.floor(np.log2(node)) + correction[tree, node]
            yield pdf.assign(score=np.power(2.0, -depth / len(feature) / normal))

    return df.mapInPandas(score, schema)


def _with_vector(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight``: rows over classes times class rows; the class table has one row per class."""
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = classes.agg(F.struct(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    weighted = classes.select(label, (total.getField("n") / (total.getField("k") * F.col("_n"))).alias("weight"))
    return df.join(small_table(weighted, "weights"), label)


def fit_logreg(train: DataFrame, features: str = "features", max_iter: int = 200) -> PipelineModel:
    """Standardised, class-balanced logistic regression with an L2 penalty of unit strength."""
    rows = balanced_weights(_with_vector(train, features))
    n = rows.count()
    stages = [
        StandardScaler(inputCol="_x", outputCol="_s", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_s", labelCol="label", weightCol="weight", maxIter=max_iter,
                           regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False),
    ]
    return Pipeline(stages=stages).fit(rows)


def fit_gbt(train: DataFrame, features: str = "features", iterations: int = 300, depth: int = 6, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees."""
    stage = GBTClassifier(featuresCol="_x", labelCol="label", maxDepth=depth, stepSize=0.05, maxIter=iterations, seed=seed)
    return Pipeline(stages=[stage]).fit(_with_vector(train, features))


def score_supervised(df: DataFrame, model: PipelineModel, name: str, features: str = "features") -> DataFrame:
    """Add column ``name`` with the probability of the anomalous class."""
    keep = [c for c in df.columns]
    return model.transform(_with_vector(df, features)).select(
        *keep, vector_to_array("probability")[1].alias(name)
    )


def fit_severity(train: DataFrame, features: str, dim: int, classes: int = 3, hidden: int = 16, seed: int = 42) -> PipelineModel:
    """Small perceptron over latent vector and error, with ``severity`` as label."""
    stages = [
        StandardScaler(inputCol="_x", outputCol="_s", withMean=True, withStd=True),
        MultilayerPerceptronClassifier(featuresCol="_s", labelCol="severity", layers=[dim, hidden, classes],
                                       maxIter=100, seed=seed),
    ]
    return Pipeline(stages=stages).fit(_with_vector(train, features))


def classify_severity(df: DataFrame, model: PipelineModel, features: str, names: tuple[str, ...] = ("info", "warning", "critical")) -> DataFrame:
    """Add ``severity_label``, ``confidence`` and ``probabilities``."""
    scored = model.transform(_with_vector(df, features))
    probabilities = vector_to_array("probability")
    return scored.select(
        *df.columns,
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("prediction").cast("int") + 1).alias("severity_label"),
        F.array_max(probabilities).alias("confidence"),
        probabilities.alias("probabilities"),
    )
