"""The alert flow with its model fitted once and applied later, to a table or to a stream.

Fit: template dictionary, transition probabilities, and the score threshold of the training windows. Apply: look
up ids, surprise of each step from the saved transitions, rolling windows, score, threshold, gate and cooldown. The
batch form orders events by windows over the table; the streaming form holds the last event, the last window and
the last firing of each key in state. Both join the same saved tables, which Catalyst broadcasts when their files
are small and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark import artefacts as af
from logspark.functions.events import stream_key
from logspark.operators import alerts as al
from logspark.operators import features as ft
from logspark.operators import thresholds as th
from logspark.operators import transitions as tr
from logspark.operators import windows as wn
from logspark.operators.ordering import with_position
from logspark.operators.templates import OFFSET, fit_dictionary, lookup_ids
from logspark.session import materialise
from logspark.streaming import flow as st

ORDER = ["timestamp", "line_no"]
MODEL = "transitions"
FLAGGED = ["stream_key", "emit_index", "timestamp", "label", "risk_score", "threshold", "fallback_reason", "is_anomaly"]


def keyed_tokens(events: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """``stream_key, timestamp, line_no, template_id, token_id, label``; id 0 for texts not fitted."""
    keyed = events.withColumn("stream_key", stream_key(F.col("service"), F.col("session_id")))
    keyed = keyed.withColumn("template_id", F.lit(0)) if dictionary is None else lookup_ids(keyed, dictionary)
    return keyed.select("stream_key", *ORDER, "template_id", (F.col("template_id") + OFFSET).alias("token_id"), "label")


def surprise(steps: DataFrame, model: af.Artefacts) -> DataFrame:
    """Add ``nll`` of ``template_id`` after ``token``; null for a first event or without a model."""
    if "transitions" not in model.tables or "sources" not in model.tables:
        return steps.withColumn("nll", F.lit(None).cast("double"))
    seen = model.tables["transitions"].select("token", F.col("next_token").alias("template_id"), "prob")
    alpha, size = F.lit(float(model.params["alpha"])), F.lit(int(model.params["vocabulary"]))
    unseen = alpha / (F.coalesce("from_cnt", F.lit(0)) + alpha * size)
    found = steps.join(seen, ["token", "template_id"], "left").join(model.tables["sources"], "token", "left")
    nll = F.when(F.col("token").isNotNull(), -F.log(F.coalesce("prob", unseen)))
    return found.withColumn("nll", nll).drop("prob", "from_cnt")


def mean_surprise(nll: Column) -> Column:
    """Mean of the steps inside a window; the step into its first event is outside."""
    inner = F.slice(nll, 2, F.greatest(F.size(nll) - 1, F.lit(0)))
    return F.aggregate(inner, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(inner), F.lit(1))


def windows_of(tokens: DataFrame, model: af.Artefacts, window: int, stride: int) -> DataFrame:
    """Rolling windows of a table with ``score``; null without a model."""
    placed = with_position(tokens.withColumn("own", F.col("template_id")), ["stream_key"], ORDER, following={"next_token": "template_id"})
    steps = placed.select("stream_key", *ORDER, "token_id", "label", F.col("own").alias("token"), F.col("next_token").alias("template_id"))
    # here a step is carried by the event it leaves, so the last one of a window is outside
    scored = surprise(steps, model)
    cut = wn.rolling_windows(scored, ORDER, window, stride, values=["nll"])
    inner = F.slice("nll", 1, F.size("nll") - 1)
    mean = F.aggregate(inner, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(inner), F.lit(1))
    return cut.withColumn("score", mean).drop("nll")


def fit(
    events: DataFrame, folder: str, window: int = 50, stride: int = 10, alpha: float = 0.1, percentile: float = 95.0
) -> str:
    """Fit the flow to ``events`` (``service, session_id, timestamp, line_no, template_text, label``) and save it."""
    spark = events.sparkSession
    dictionary = fit_dictionary(events)
    tokens = materialise(keyed_tokens(events, dictionary), "fit-tokens")
    placed = with_position(tokens, ["stream_key"], ORDER, following={"next_token": "template_id"})
    steps = materialise(placed.groupBy(F.col("template_id").alias("token"), "next_token").agg(F.count(F.lit(1)).alias("cnt")), "fit-steps")
    vocabulary = steps.select("token").distinct()
    transitions = materialise(tr.transition_model(ft.transition_counts(steps), vocabulary, alpha), "fit-transitions")
    params = {"window": window, "stride": stride, "alpha": alpha, "percentile": percentile, "vocabulary": vocabulary.count()}
    tables = {"dictionary": dictionary, "transitions": transitions, "sources": transitions.select("token", "from_cnt").distinct()}
    scored = windows_of(tokens, af.Artefacts("", params, tables), window, stride)
    limit = th.exact_quantiles(scored, "score", {"threshold": percentile / 100})
    thresholds = limit.select(F.lit(MODEL).alias("model"), "threshold")
    return af.save(spark, folder, {**tables, "thresholds": thresholds}, params)


def threshold_of(model: af.Artefacts, default: float) -> float:
    """The saved threshold of the flow's model, one row."""
    row = model.tables["thresholds"].where(F.col("model") == MODEL).first() if "thresholds" in model.tables else None
    return default if row is None or row["threshold"] is None else float(row["threshold"])


def flagged_windows(windows: DataFrame, model: af.Artefacts, fallback_score: float, default_threshold: float) -> DataFrame:
    """Score, fallback reason, threshold and decision of windows with ``score``."""
    have = {"transitions", "sources", "dictionary"} <= set(model.tables)
    judged = windows.withColumns({
        "fallback_reason": F.lit("") if have else F.lit("no model"),
        "score": F.coalesce("score", F.lit(float(fallback_score))) if have else F.lit(float(fallback_score)),
    })
    return al.risk_results(judged, MODEL, F.col("score"), F.lit(threshold_of(model, default_threshold)))


def apply(
    events: DataFrame, model: af.Artefacts, cooldown_seconds: float = 60.0, fallback_score: float = 0.0, default_threshold: float = 1.0,
    window: int = 50, stride: int = 10,
) -> DataFrame:
    """Gated alerts of a table with ``fired``; ``window`` and ``stride`` are the saved ones where there are any.

    Without a saved model every window gets ``fallback_score`` and says so in ``fallback_reason``.
    """
    window, stride = int(model.params.get("window", window)), int(model.params.get("stride", stride))
    tokens = keyed_tokens(events, model.tables.get("dictionary"))
    scored = materialise(windows_of(tokens, model, window, stride), "applied-windows")
    gated = al.alert_gate(flagged_windows(scored, model, fallback_score, default_threshold)).select(*FLAGGED)
    return al.cooldown(gated, "stream_key", ["timestamp", "emit_index"], cooldown_seconds)


def apply_stream(
    events: DataFrame, model: af.Artefacts, cooldown_seconds: float = 60.0, fallback_score: float = 0.0, default_threshold: float = 1.0,
    window: int = 50, stride: int = 10, ttl_ms: int | None = None,
) -> DataFrame:
    """The same alerts of a stream of events, in append mode.

    Events of a key count in the order of micro-batches, and inside one by time and line; a key that is silent for
    ``ttl_ms`` is forgotten and starts anew.
    """
    window, stride = int(model.params.get("window", window)), int(model.params.get("stride", stride))
    tokens = keyed_tokens(events, model.tables.get("dictionary"))
    scored = surprise(st.stream_steps(tokens, ttl_ms), model)
    cut = st.stream_scored_windows(scored, window, stride, ttl_ms)
    windows = cut.withColumn("score", mean_surprise(F.col("nll"))).drop("nll")
    gated = al.alert_gate(flagged_windows(windows, model, fallback_score, default_threshold)).select(*FLAGGED)
    return st.stream_fired(gated, cooldown_seconds, ttl_ms)
