"""Decision thresholds: F1 sweep, percentiles, runtime calibration, resolution, ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.operators.ordering import exact_quantiles
from logspark.session import small_table


def _candidate(i: Column, n: int) -> Column:
    """Candidate ``i`` of ``n`` evenly spaced values from ``lo`` to ``hi``."""
    lo, hi = F.col("lo"), F.col("hi")
    return F.when(i >= n - 1, hi).otherwise(lo + i * ((hi - lo) / F.lit(float(n - 1))))


def sweep(df: DataFrame, ends: DataFrame, n: int, keys: list[str] = ()) -> DataFrame:
    """Confusion counts at each of ``n`` candidate thresholds between ``lo`` and ``hi`` of ``ends``.

    Every score is counted once under the highest candidate it reaches; running sums over these at
    most ``n + 1`` rows per key then give the counts of all candidates. ``ends`` has one row per key.
    """
    keys = list(keys)
    one = {"_one": F.lit(1)}
    on = keys or ["_one"]
    scored = df if keys else df.withColumns(one)
    limits = ends if keys else ends.withColumns(one)
    step = (F.col("hi") - F.col("lo")) / F.lit(float(n - 1))
    guess = F.least(
        F.lit(float(n - 1)),
        F.greatest(F.lit(-1.0), F.floor((F.col("score") - F.col("lo")) / F.nullif(step, F.lit(0.0))).cast("double")),
    )
    guess = F.when(F.col("score") < F.col("lo"), F.lit(-1.0)).otherwise(F.coalesce(guess, F.lit(float(n - 1))))
    # rounding may put a score one step off: compare with the candidates on both sides
    exact = (
        F.when((F.col("_g") < n - 1) & (F.col("score") >= _candidate(F.col("_g") + 1, n)), F.col("_g") + 1)
        .when((F.col("_g") >= 0) & (F.col("score") < _candidate(F.col("_g"), n)), F.col("_g") - 1)
        .otherwise(F.col("_g"))
    )
    counted = (
        scored.join(limits, on)
        .withColumn("_g", guess)
        .groupBy(*on, exact.cast("int").alias("_i"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("label").cast("bigint").alias("_pos"))
    )
    grid = limits.select(*on, "lo", "hi", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))).alias("_i"))
    above = Window.partitionBy(*on).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*on)
    zero = F.lit(0).cast("bigint")
    filled = grid.join(counted, [*on, "_i"], "left").select(
        *on, "lo", "hi", "_i", F.coalesce("_n", zero).alias("_n"), F.coalesce("_pos", zero).alias("_pos")
    )
    return (
        filled.select(
            *on, "_i", _candidate(F.col("_i").cast("double"), n).alias("threshold"),
            F.sum("_n").over(above).alias("n_pred"),
            F.sum("_pos").over(above).alias("tp"),
            F.sum("_n").over(everything).alias("n"),
            F.sum("_pos").over(everything).alias("support"),
        )
        .where(F.col("_i") >= 0)
        .select(
            *keys, F.col("_i").alias("candidate"), "threshold", "tp",
            (F.col("n_pred") - F.col("tp")).alias("fp"),
            (F.col("support") - F.col("tp")).alias("fn"),
            "n", "support",
        )
    )


def _best(swept: DataFrame, f1: Column, keys: list[str]) -> DataFrame:
    """Candidate with the highest F1 per key, the lowest candidate on a tie."""
    scored = swept.withColumn("f1", f1)
    choice = F.max_by(
        F.struct("threshold", "f1", "tp", "fp", "fn", "n", "support"), F.struct("f1", -F.col("candidate"))
    )
    return scored.groupBy(*keys).agg(choice.alias("b")).select(*keys, "b.*")


def f1_threshold(df: DataFrame, keys: list[str] = (), n: int = 300) -> DataFrame:
    """F1-optimal threshold over ``n`` candidates between the 1st and 99th percentile, per key."""
    keys = list(keys)
    ends = exact_quantiles(df, "score", {"lo": 0.01, "hi": 0.99}, keys)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    denominator = (2 * tp + fp + fn).cast("double")
    f1 = F.when(denominator == 0, 0.0).otherwise(2.0 * tp / denominator)
    best = _best(sweep(df, ends, n, keys), f1, keys)
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return best.select(
        *keys, "threshold", "f1",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tp + fp, F.col("n")).alias("pct_pred"),
        "support", "n",
    )


def predict_both(df: DataFrame, overall: DataFrame, by_group: DataFrame, group: str) -> DataFrame:
    """Add ``pred_overall`` and ``pred_by_group``; the thresholds are a scalar and one row per group."""
    limits = small_table(by_group.select(group, F.col("threshold").alias("_t")), "limits")
    return df.join(limits, group, "left").withColumns({
        "pred_overall": (F.col("score") >= overall.select("threshold").scalar()).cast("int"),
        "pred_by_group": (F.col("score") >= F.col("_t")).cast("int"),
    }).drop("_t")


def percentile_threshold(df: DataFrame, percentile: float = 95.0, keys: list[str] = ()) -> DataFrame:
    """Percentile of the scores of normal rows."""
    if not 0 < percentile <= 100:
        raise ValueError("percentile must be in (0, 100]")
    return exact_quantiles(df.where(F.col("label") == 0), "score", {"threshold": percentile / 100}, keys)


def runtime_threshold(
    df: DataFrame, keys: list[str], alert_rate: float, n: int = 200, min_labels: int = 20, max_rate: float = 0.5
) -> DataFrame:
    """Per key: F1 sweep over the score range when labels allow it, else the ``1 - alert_rate`` quantile.

    The sweep needs ``min_labels`` labelled rows of both classes and is rejected when it would flag
    more than ``max_rate`` of all rows.
    """
    labelled = df.where(F.col("label").isNotNull())
    ends = labelled.groupBy(*keys).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    eps = F.lit(1e-9)
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    precision, recall = tp / (tp + fp + eps), tp / (tp + fn + eps)
    f1 = 2 * precision * recall / (precision + recall + eps)
    best = small_table(
        _best(sweep(labelled, ends, n, keys), f1, keys).select(*keys, F.col("threshold").alias("_f1_thr"), "f1"), "best"
    )
    stats = labelled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("label").alias("_lo"), F.max("label").alias("_hi")
    )
    quantile = exact_quantiles(df, "score", {"_q": 1.0 - alert_rate}, keys)
    joined = quantile.join(best, keys, "left").join(stats, keys, "left")
    rate = df.join(best, keys).groupBy(*keys).agg(F.avg((F.col("score") >= F.col("_f1_thr")).cast("int")).alias("_rate"))
    usable = (F.col("_n") >= min_labels) & (F.col("_lo") != F.col("_hi")) & (F.col("_rate") <= max_rate)
    usable = F.coalesce(usable, F.lit(False))
    return joined.join(rate, keys, "left").select(
        *keys,
        F.when(usable, F.col("_f1_thr")).otherwise(F.col("_q")).alias("threshold"),
        F.when(usable, "f1").otherwise("percentile").alias("method"),
    )


def score_stats(df: DataFrame, keys: list[str], thresholds: DataFrame | None = None) -> DataFrame:
    """Minimum, p50, p95, p99 and maximum per key, and the achieved alert rate where thresholds are given."""
    ends = df.groupBy(*keys).agg(F.min("score").alias("min"), F.max("score").alias("max"))
    out = ends.join(exact_quantiles(df, "score", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, keys), keys)
    if thresholds is None:
        return out
    limits = small_table(thresholds.select(*keys, "threshold"), "limits")
    hit = F.avg((F.col("score") >= F.col("threshold")).cast("int")).alias("alert_rate")
    return out.join(df.join(limits, keys).groupBy(*keys).agg(hit), keys, "left")


def resolve_thresholds(defaults: DataFrame, runtime: DataFrame) -> DataFrame:
    """``model, threshold``: the runtime value where there is one, else the default."""
    override = runtime.select("model", F.col("threshold").alias("_rt"))
    return defaults.join(override, "model", "left").select(
        "model", F.coalesce("_rt", "threshold").alias("threshold"), F.col("_rt").isNotNull().alias("overridden")
    )


def ensemble_score(scores: DataFrame, thresholds: DataFrame, key: list[str]) -> DataFrame:
    """Mean over models of score divided by its threshold; the decision threshold is 1.

    ``scores`` is long: key, ``model``, ``score``; there is one threshold per model.
    """
    share = F.col("score") / (F.col("threshold") + F.lit(1e-9))
    limits = small_table(thresholds.select("model", "threshold"), "limits")
    return scores.join(limits, "model").groupBy(*key).agg(
        F.avg(share).alias("score")
    ).withColumn("is_anomaly", F.col("score") >= 1.0)


def score_with_fallback(items: DataFrame, scores: DataFrame, key: list[str], default: float = 0.0) -> DataFrame:
    """Score of each item; the configured constant and a reason where no model gave one."""
    return items.join(scores.select(*key, "score"), key, "left").withColumns({
        "fallback_reason": F.when(F.col("score").isNull(), "no model score").otherwise(""),
        "score": F.coalesce("score", F.lit(float(default))),
    })


def severity_terciles(df: DataFrame, score: str = "score") -> DataFrame:
    """Add ``severity``: 0 below p33, 1 below p66, else 2."""
    cuts = exact_quantiles(df, score, {"p33": 0.33, "p66": 0.66}).select(F.struct("p33", "p66")).scalar()
    level = F.when(F.col(score) >= cuts.getField("p66"), 2).when(F.col(score) >= cuts.getField("p33"), 1).otherwise(0)
    return df.withColumn("severity", level)


def contamination_labels(df: DataFrame, contaminations: list[float]) -> DataFrame:
    """``contamination, threshold, n_flagged``: rows above the quantile that leaves that share of them."""
    names = {f"c{i}": 1.0 - c for i, c in enumerate(contaminations)}
    cuts = exact_quantiles(df, "score", names)
    pairs = F.array(*[
        F.struct(F.lit(c).alias("contamination"), F.col(f"c{i}").alias("threshold"))
        for i, c in enumerate(contaminations)
    ])
    table = cuts.select(F.inline(pairs))
    flagged = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("contamination"),
                 (F.col("score") > cuts.select(f"c{i}").scalar()).alias("hit"), F.col("label"))
        for i, c in enumerate(contaminations)
    ]))).groupBy("contamination").agg(
        F.count_if("hit").alias("n_flagged"),
        F.count_if(F.col("hit") & (F.col("label") == 1)).alias("n_true"),
    )
    return table.join(flagged, "contamination")
