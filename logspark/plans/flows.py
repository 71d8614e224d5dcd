"""End-to-end flows: token events to alerts, raw lines to alerts, session evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.functions.events import path_key, stream_key
from logspark.operators import alerts as al
from logspark.operators import features as ft
from logspark.operators import models as md
from logspark.operators import thresholds as th
from logspark.operators import transitions as tr
from logspark.operators import vectors as vc
from logspark.operators import windows as wn
from logspark.operators.ordering import count_windows, with_position
from logspark.operators.templates import fit_dictionary, lookup_ids, with_template
from logspark.session import materialise

ORDER = ["timestamp", "line_no"]


def scored_windows(
    tokens: DataFrame, window: int = 50, stride: int = 10, alpha: float = 0.1, order: list[str] = ORDER
) -> DataFrame:
    """Rolling windows with the mean next-token surprise of their steps as ``score``.

    Events are put in order once and written; the transition counts and the windows both read that
    table. The surprise of a step is looked up once per event and travels into the windows, so the
    overlap of windows costs no further lookups.
    """
    keyed = tokens.withColumn("stream_key", stream_key(F.col("service"), F.col("session_id")))
    narrow = keyed.select("stream_key", *order, "template_id", "token_id", "label")
    placed = materialise(with_position(narrow, ["stream_key"], order, following={"next_token": "template_id"}), "placed")
    steps = placed.groupBy(F.col("template_id").alias("token"), "next_token").agg(F.count(F.lit(1)).alias("cnt"))
    vocab = steps.select("token").distinct()
    model = materialise(tr.transition_model(ft.transition_counts(steps), vocab, alpha), "transitions")
    surprised = tr.event_surprise(placed, model, vocab, alpha)
    cut = wn.rolling_windows(surprised, order, window, stride, values=["nll"])
    inner = F.slice("nll", 1, F.size("nll") - 1)
    mean = F.aggregate(inner, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(inner), F.lit(1))
    return cut.withColumn("score", mean).drop("nll")


def windowed_alerts(
    tokens: DataFrame, window: int = 50, stride: int = 10, percentile: float = 95.0, cooldown_seconds: float = 60.0,
    order: list[str] = ORDER,
) -> tuple[DataFrame, DataFrame]:
    """``(risks, alerts)`` of a token stream: windows, surprise, percentile threshold, gate, cooldown."""
    scored = materialise(scored_windows(tokens, window, stride, order=order), "windows")
    limit = th.exact_quantiles(scored, "score", {"threshold": percentile / 100})
    risks = al.risk_results(wn.evidence(scored), "transitions", F.col("score"), limit.scalar())
    gated = al.alert_gate(risks).select(
        "stream_key", "timestamp", "emit_index", "model", "risk_score", "threshold", "is_anomaly", "label",
        "window_size", "emit_number", "evidence_window", "tokens",
    )
    flagged = al.cooldown(gated, "stream_key", ["timestamp", "emit_index"], cooldown_seconds)
    return risks, flagged


def raw_line_scores(
    lines: DataFrame, dim: int = 16, window: int = 10, stride: int = 1, percentile: float = 95.0,
    order: list[str] = ORDER,
) -> DataFrame:
    """Raw lines to severities: token, vector, window context, reconstruction error, severity class.

    Lines are generalised once and put in order once; both tables are written. Windows carry template ids, not
    vectors, and are turned into their contexts where they are.
    """
    templated = materialise(
        with_template(lines).select(path_key(F.col("service"), F.col("session_id")).alias("stream_key"), *order, "template_text", "label"),
        "templated",
    )
    tokens = lookup_ids(templated, fit_dictionary(templated)).select(
        "stream_key", *order, F.col("template_id").cast("string").alias("token"), "template_id",
        (F.col("template_id") + 2).alias("token_id"), "label",
    )
    keyed = materialise(with_position(tokens, ["stream_key"], order), "tokens")
    sentences = count_windows(keyed, ["stream_key"], order, ["token"], window, window, keep_short=True).select(
        F.col("rows.token").alias("tokens")
    )
    vectors = vc.token_embeddings(sentences, dim=dim, window=5, epochs=3, partitions=vc.training_tasks(keyed.count()))
    vectors = materialise(vectors.select(F.col("token").cast("int").alias("template_id"), "vector"), "vectors")
    cut = wn.rolling_windows(keyed, order, window, stride, values=["template_id"]).select(
        "stream_key", "emit_index", "sequence_id", "label",
        F.coalesce(F.element_at("timestamps", -1), F.lit(0.0)).alias("timestamp"), "template_id",
    )
    windows = materialise(vc.window_contexts(cut, "template_id", vectors, dim), "contexts")
    auto = vc.fit_reconstruction(windows.where(F.coalesce("label", F.lit(0)) == 0), k=max(2, dim // 4))
    errors = materialise(vc.reconstruction(windows, auto), "errors")
    limit = th.percentile_threshold(errors.select(F.col("error").alias("score"), F.coalesce("label", F.lit(0)).alias("label")), percentile)
    labelled = th.severity_terciles(errors, "error").withColumn("features", F.concat("latent", F.array("error")))
    classifier = md.fit_severity(labelled, "features", max(2, dim // 4) + 1)
    return md.classify_severity(labelled, classifier, "features").withColumn(
        "threshold", limit.scalar()
    ).withColumn("is_anomaly", al.decide(F.col("error"), F.col("threshold"), strict=True))


def raw_line_alerts(lines: DataFrame, cooldown_seconds: float = 60.0, **kw) -> DataFrame:
    """Alerts of raw lines, with class severity, confidence and probabilities."""
    scored = raw_line_scores(lines, **kw).where("is_anomaly").select(
        "stream_key", "timestamp", "emit_index", F.col("error").alias("score"), "threshold",
        "severity_label", "confidence", "probabilities",
    )
    fired = al.cooldown(scored, "stream_key", ["timestamp", "emit_index"], cooldown_seconds).where("fired")
    service = F.element_at(F.split("stream_key", "/"), 1)
    return fired.select(
        F.sha2(F.concat_ws("|", "stream_key", F.col("timestamp").cast("string"), F.col("emit_index").cast("string")), 256).alias("alert_id"),
        F.col("severity_label").alias("severity"), service.alias("service"), "score", "timestamp", "stream_key",
        "confidence", "probabilities", F.lit("raw_lines").alias("model_name"),
        al.alert_message(service, F.col("severity_label"), F.col("score"), F.col("confidence")).alias("message"),
    )


def session_feature_vectors(df: DataFrame, order: list[str], k: int = 100, m: int = 100) -> DataFrame:
    """``session_id, features``: dense feature arrays of the fitted vocabulary, ready for the models."""
    steps = ft.session_steps(df, order)
    fitted = ft.FeatureModel.fit(steps, k, m)
    wide = fitted.wide(fitted.transform(steps))
    return wide.select("session_id", F.array(*[c for c in wide.columns if c != "session_id"]).alias("features"))
