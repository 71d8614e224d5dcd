"""Evaluation: confusion metrics, curves, histograms, verdicts, data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.operators.ordering import rank_within, running_sums


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def confusion_metrics(df: DataFrame, keys: list[str] = (), pred: str = "pred", label: str = "label") -> DataFrame:
    """Confusion counts and rates per key; a null prediction counts as negative, a null label is skipped."""
    hit = F.coalesce(F.col(pred).cast("int"), F.lit(0)) == 1
    pos = F.col(label) == 1
    known = F.col(label).isNotNull()
    counts = df.groupBy(*keys).agg(
        F.count_if(known).alias("total"),
        F.count_if(~known).alias("skipped"),
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & known & ~pos).alias("fp"),
        F.count_if(~hit & known & ~pos).alias("tn"),
        F.count_if(~hit & pos).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio((2 * tp).cast("double"), 2 * tp + fp + fn),
        "fpr": _ratio(fp, fp + tn),
        "pct_pred": _ratio(tp + fp, F.col("total")),
    })


def _score_sums(df: DataFrame, keys: list[str], descending: bool) -> DataFrame:
    rows = df.select(
        *keys, "score",
        F.col("label").cast("bigint").alias("pos"), (1 - F.col("label")).cast("bigint").alias("neg"),
    )
    return running_sums(rows, list(keys), "score", ["pos", "neg"], descending=descending)


def roc_auc(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums, ties counted half; null when a class is absent."""
    summed = _score_sums(df, list(keys), descending=False)
    below = F.col("cum_neg") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    pairs = F.max(F.col("all_pos").cast("double") * F.col("all_neg"))
    return summed.groupBy(*keys).agg((wins / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def average_precision(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Step-wise area under precision and recall: sum of recall gain times precision over distinct scores."""
    summed = _score_sums(df, list(keys), descending=True)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    gain = F.col("pos") / F.nullif(F.col("all_pos"), F.lit(0))
    return summed.groupBy(*keys).agg(F.coalesce(F.sum(gain * precision), F.lit(0.0)).alias("average_precision"))


def curve_points(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Threshold, false-positive rate, recall and precision at each distinct score."""
    summed = _score_sums(df, list(keys), descending=True)
    return summed.select(
        *keys, F.col("score").alias("threshold"),
        _ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        _ratio(F.col("cum_pos"), F.col("all_pos")).alias("recall"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
    )


def score_histogram(df: DataFrame, bins: int = 59) -> DataFrame:
    """Count and density of each label in equal-width bins between the lowest and highest score."""
    ends = df.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi"))).scalar()
    width = (ends.getField("hi") - ends.getField("lo")) / bins
    bin_no = F.least(F.lit(bins - 1), F.floor((F.col("score") - ends.getField("lo")) / width)).cast("int")
    counted = df.groupBy("label", bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    per_label = F.sum("n").over(Window.partitionBy("label"))
    return counted.withColumn("_all", per_label).select(
        "label", "bin", "n",
        (ends.getField("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("n") / (F.col("_all") * width)).alias("density"),
    )


def eval_by_group(df: DataFrame, group: str, modes: list[str]) -> DataFrame:
    """Confusion metrics per group and prediction column, and over all groups; one pass over the scores."""
    pairs = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("pred")) for m in modes])
    groups = F.array(F.col(group), F.lit("ALL"))
    long = df.select(F.explode(groups).alias("scope"), "label", pairs.alias("_p")).select(
        "scope", "label", F.inline("_p")
    )
    return confusion_metrics(long, ["scope", "mode"])


def class_report(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Precision, recall, F1 and support of each class, from one count per (label, prediction) pair."""
    pairs = df.groupBy(F.col(label).alias("_l"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sides = F.array(
        F.struct(F.col("_l").alias("class"), F.lit(1).alias("is_label")),
        F.struct(F.col("_p").alias("class"), F.lit(0).alias("is_label")),
    )
    long = pairs.select("_n", (F.col("_l") == F.col("_p")).alias("hit"), F.inline(sides))
    per = long.groupBy("class").agg(
        F.sum(F.when(F.col("is_label") == 1, F.col("_n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("is_label") == 0, F.col("_n")).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col("is_label") == 1) & F.col("hit"), F.col("_n")).otherwise(0)).alias("_tp"),
    )
    tp = F.col("_tp")
    return per.select(
        "class",
        _ratio(tp, F.col("predicted")).alias("precision"),
        _ratio(tp, F.col("support")).alias("recall"),
        _ratio((2 * tp).cast("double"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )


def session_verdict(sessions: DataFrame, windows: DataFrame, key: str = "session_id") -> DataFrame:
    """Anomaly verdict per session: true when any window is; null ``raw_verdict`` when it has no window."""
    any_hit = windows.groupBy(key).agg(F.bool_or("is_anomaly").alias("raw_verdict"))
    return sessions.join(any_hit, key, "left").withColumn("pred", F.coalesce("raw_verdict", F.lit(False)).cast("int"))


def metric_rows(metrics: DataFrame, names: list[str], keys: list[str] = ()) -> DataFrame:
    """Long form ``metric, value``."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select(*keys, F.inline(pairs))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metric values of two runs and their difference; a metric only one run has stays."""
    left = a.select("metric", F.col("value").alias("value_a"))
    right = b.select("metric", F.col("value").alias("value_b"))
    return left.join(right, "metric", "full").withColumn("delta", F.col("value_b") - F.col("value_a"))


def select_model(scores: DataFrame, models: list[str]) -> DataFrame:
    """Average precision of each model on the validation rows, best first by rank."""
    long = scores.select("label", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models
    ])))
    quality = average_precision(long, ["model"]).join(roc_auc(long, ["model"]), "model")
    best = Window.orderBy(F.desc("average_precision"), F.asc("model"))  # one row per model
    return quality.withColumn("rank", F.row_number().over(best))


def dq_report(df: DataFrame, label: str, text: str, number: str, phase: str | None = None, phases: list[str] = ()) -> DataFrame:
    """Data-quality checks in one pass: rows, both classes, phases, empty texts, null numbers."""
    checks = {
        "row_count": (F.count(F.lit(1)), lambda n: n > 0),
        "label_normal_present": (F.count_if(F.col(label) == 0), lambda n: n > 0),
        "label_anomaly_present": (F.count_if(F.col(label) == 1), lambda n: n > 0),
        "label_other": (F.count_if(~F.col(label).isin(0, 1) | F.col(label).isNull()), lambda n: n == 0),
        "empty_message": (F.count_if(F.trim(F.coalesce(text, F.lit(""))) == ""), lambda n: n == 0),
        "missing_number": (F.count_if(F.col(number).isNull() | F.isnan(number)), lambda n: n == 0),
    }
    for p in phases:
        checks[f"phase_{p}"] = (F.count_if(F.col(phase) == p), lambda n: n > 0)
    counted = df.agg(*[expr.alias(name) for name, (expr, _) in checks.items()])
    rows = [
        F.struct(
            F.lit(name).alias("check"),
            F.when(ok(F.col(name)), "pass").otherwise("fail").alias("status"),
            F.col(name).alias("n"),
        )
        for name, (_, ok) in checks.items()
    ]
    return counted.select(F.inline(F.array(*rows)))


def distribution_report(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Rows, anomalies and label rate per group."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).cast("bigint").alias("n_anomaly"), F.avg(label).alias("label_rate")
    )


def first_messages(df: DataFrame, group: str, order: list[str], text: str, n: int = 3) -> DataFrame:
    """First ``n`` messages of each group; the rank limit already cuts every group before the shuffle."""
    ranked = rank_within(df.select(group, *order, text), [group], [F.asc(c) for c in order], n)
    return ranked.select(group, "rank", text)


def latency_summary(df: DataFrame, latency: str, time: str, flag: str, keys: list[str] = ()) -> DataFrame:
    """Mean and nearest-rank p95 latency, events per second of the time span, anomaly rate, per key."""
    keys = list(keys)
    rows = df.select(*keys, latency, F.lit(1).cast("bigint").alias("n"))
    ranked = running_sums(rows, keys, latency, ["n"])
    rank = F.greatest(F.lit(1), F.floor(F.col("all_n") * F.lit(0.95)))
    p95 = ranked.where((F.col("cum_n") - F.col("n") < rank) & (rank <= F.col("cum_n"))).select(
        *keys, F.col(latency).alias("p95_latency")
    )
    span = F.nullif(F.max(time) - F.min(time), F.lit(0.0))
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.avg(latency).alias("mean_latency"),
        F.coalesce(F.count(F.lit(1)) / span, F.lit(0.0)).alias("events_per_sec"),
        (F.avg(F.col(flag).cast("int")) * 100).alias("anomaly_rate_pct"),
    )
    if keys:
        return base.join(p95, keys)
    return base.withColumn("p95_latency", p95.scalar())
