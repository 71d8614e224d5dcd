"""Registered queries: one per operator, each over the whole shared tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark import artefacts as af
from logspark.functions import events as ev
from logspark.functions import text as tx
from logspark.operators import alerts as al
from logspark.operators import evaluate as evl
from logspark.operators import features as ft
from logspark.operators import models as md
from logspark.operators import opsmetrics as om
from logspark.operators import sampling as sm
from logspark.operators import sequences as sq
from logspark.operators import templates as tp
from logspark.operators import thresholds as th
from logspark.operators import transitions as tr
from logspark.operators import vectors as vc
from logspark.operators import windows as wn
from logspark.operators.ordering import exact_quantiles
from logspark.plans import bindings as bd
from logspark.plans import flows, online
from logspark.schema import TOKEN_STREAM, UNIFIED_EVENTS, column_report
from logspark.session import materialise, spread, workspace
from logspark.sources import readers as rd
from logspark.sources import sinks as sk
from logspark.streaming import alerts as st_alerts
from logspark.streaming import metrics as st_metrics
from logspark.streaming import windows as st_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

ORDER = ["timestamp", "line_no"]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register under the function's name."""
    QUERIES[fn.__name__] = fn
    return fn


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _join(c: Column | str) -> Column:
    return F.concat_ws(",", (F.col(c) if isinstance(c, str) else c).cast("array<string>"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/logspark/{name}-{uuid.uuid4().hex}"


# ---- sources and sinks -------------------------------------------------------------------------


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines followed by the lines of all documents, in one numbering."""
    logs = bd.log_lines(spark, sf).select(F.lit(-1).cast("bigint").alias("doc_id"), "line_no", F.col("message").alias("line"))
    docs = bd.text_lines_of_documents(spark, sf).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")
    both = logs.unionByName(docs).withColumnRenamed("line_no", "_at")
    return rd.number_lines(both, ["doc_id", "_at"]).select("line_no", "line")


@query
def src_block_lines(spark, sf):
    return rd.block_lines(_lines(spark, sf)).select("line_no", "dataset", "session_id", "message")


@query
def src_chunk_sessions(spark, sf):
    return rd.chunk_lines(_lines(spark, sf)).select("line_no", "dataset", "session_id", "message", "label")


@query
def src_text_files(spark, sf):
    path = _folder(spark, "text")
    bd.log_lines(spark, sf).orderBy("line_no").select("message").write.text(path)
    return rd.text_lines(spark, path, across=True).select("line_no", F.col("line").alias("message"))


@query
def scan_unified(spark, sf):
    path = _folder(spark, "csv")
    logs = bd.log_lines(spark, sf).withColumnRenamed("service", "dataset")
    sk.write_results(logs.select(*UNIFIED_EVENTS.names), path, "csv")
    return rd.read_unified(spark, path).select(
        "line_no", _r("timestamp").alias("timestamp"), "dataset", "session_id", "message", F.col("label").cast("int").alias("label")
    )


@query
def ground_truth(spark, sf):
    path = _folder(spark, "truth")
    labels = bd.table(spark, sf, "labels").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("BlockId"),
        F.when(F.col("toxic") == 1, "Anomaly").otherwise("Normal").alias("Label"),
    )
    sk.write_results(labels, path, "csv")
    return rd.read_ground_truth(spark, path)


@query
def dq_required_columns(spark, sf):
    return column_report(bd.table(spark, sf, "documents"), ["doc_id", "text", "lang", "source", "n_chars", "session_id"])


@query
def sink_canonical(spark, sf):
    path = _folder(spark, "canonical")
    sk.write_canonical(bd.log_lines(spark, sf), path, ["timestamp"], ["service"])
    schema = "line_no bigint, timestamp double, session_id string, level string, message string, label int, service string"
    back = spark.read.schema(schema).parquet(path)
    return back.select("line_no", _r("timestamp").alias("timestamp"), "service", "session_id", "level", "message", "label")


@query
def sink_results(spark, sf):
    counts = bd.log_lines(spark, sf).groupBy("service").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = _folder(spark, fmt)
        sk.write_results(counts, path, fmt)
        reader = spark.read.schema("service string, n bigint").format(fmt)
        back = (reader.option("header", True) if fmt == "csv" else reader).load(path).withColumn("format", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


@query
def resolve_thresholds(spark, sf):
    long = _model_scores(spark, sf)
    defaults = th.percentile_threshold(long, 95.0, ["model"])
    runtime = th.percentile_threshold(long.where(F.col("model") == "a"), 99.0, ["model"])
    return th.resolve_thresholds(defaults, runtime).select("model", _r("threshold").alias("threshold"), "overridden")


# ---- projections and parsing -------------------------------------------------------------------


def _texts(spark, sf):
    logs = bd.log_lines(spark, sf).select(F.lit("log").alias("source"), F.col("line_no").alias("id"), "message")
    docs = bd.table(spark, sf, "documents").select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("message"))
    pages = bd.table(spark, sf, "pages").select(F.lit("page").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("message"))
    return spread(logs.unionByName(docs).unionByName(pages))


@query
def parse_text_logs(spark, sf):
    lines = bd.log_lines(spark, sf)
    return lines.select("line_no", tx.parse_line(F.col("message")).alias("p")).select("line_no", "p.*")


def _json_lines(spark, sf):
    """Events as JSON lines; purchases are cut off and thus no valid JSON."""
    whole = F.concat(
        F.lit('{"ts": '), F.floor(bd._epoch()).cast("string"), F.lit(', "severity": "'), F.col("event_type"),
        F.lit('", "msg": "value '), F.floor("value").cast("string"), F.lit('", "label": '),
        (F.col("event_type") == "error").cast("int").cast("string"),
        F.lit(', "props": '), F.col("props"), F.lit(', "user": "'), F.col("user_id").cast("string"), F.lit('"}'),
    )
    line = F.when(F.col("event_type") == "purchase", F.substring(whole, 1, 30)).otherwise(whole)
    return bd.table(spark, sf, "events").select("event_id", line.alias("line"))


@query
def parse_json_logs(spark, sf):
    parsed = _json_lines(spark, sf).select("event_id", tx.parse_json(F.col("line"), "default").alias("p"))
    return parsed.select(
        "event_id", "p.timestamp", "p.service", "p.level", "p.message", F.coalesce("p.label", F.lit(-1)).alias("label"),
        F.array_join(F.sort_array(F.map_keys("p.meta")), ",").alias("meta_keys"),
        F.coalesce(F.col("p.meta")["user"], F.lit("")).alias("meta_user"),
        F.coalesce(F.get_json_object(F.to_json("p.meta"), "$.user"), F.lit("")).alias("round_trip_user"),
    )


@query
def normalize_schema(spark, sf):
    unified = bd.log_lines(spark, sf).withColumnRenamed("service", "dataset").drop("level")
    return unified.select(
        "line_no", _r("timestamp").alias("timestamp"), F.col("dataset").alias("service"), F.lit("").alias("level"),
        "message", "session_id", "label",
    )


@query
def generalize_message(spark, sf):
    return _texts(spark, sf).select("source", "id", tx.generalize(F.col("message")).alias("template_text"))


@query
def clean_message(spark, sf):
    return _texts(spark, sf).select("source", "id", tx.clean(F.col("message")).alias("cleaned"))


@query
def tokenize_message(spark, sf):
    tokens = tx.tokenize(tx.clean(F.col("message")))
    return _texts(spark, sf).select("source", "id", F.size(tokens).alias("n_tokens"), F.concat_ws(" ", tokens).alias("tokens"))


@query
def message_corpus(spark, sf):
    lines = tx.message_corpus(bd.text_lines_of_documents(spark, sf), "line")
    return lines.select("doc_id", "line_no", F.concat_ws(" ", "tokens").alias("tokens"))


@query
def coerce_events(spark, sf):
    raw = bd.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "view", "not a number").when(F.col("event_type") == "click", "NaN")
        .otherwise(F.col("value").cast("string")).alias("timestamp"),
        (F.col("user_id") % 3).alias("token_id"), (F.col("event_id") % 2).alias("template_id"),
        F.col("user_id").cast("string").alias("session_id"),
    )
    return raw.select(
        "event_id", ev.safe_timestamp(F.col("timestamp")).alias("timestamp"),
        ev.coalesce_token(F.col("token_id"), F.col("template_id")).alias("token_id"),
        F.lit("").alias("service_key_session"), F.col("session_id"),
    )


@query
def stream_key(spark, sf):
    service = F.when(F.col("label") == 1, F.lit(None).cast("string")).when(F.col("level") == "WARN", "").otherwise(F.col("service"))
    session = F.when(F.col("level") == "WARN", F.lit(None).cast("string")).otherwise(F.col("session_id"))
    return bd.log_lines(spark, sf).select(
        "line_no", ev.stream_key(service, session).alias("v1_key"),
        ev.path_key(F.col("service"), session).alias("v2_key"),
        ev.stream_key(F.col("service"), F.lit("")).alias("service_key"),
    )


@query
def event_time(spark, sf):
    time = ev.epoch_to_timestamp(F.col("timestamp"))
    return bd.log_lines(spark, sf).select("line_no", F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time"))


@query
def flatten_meta(spark, sf):
    meta = F.concat(
        F.lit('{"host": "node-'), (F.col("user_id") % 7).cast("string"), F.lit('", "component": "'), F.col("event_type"),
        F.lit('", "scenario_id": '), F.get_json_object("props", "$.k"), F.lit("}"),
    )
    parsed = F.from_json(meta, "map<string,string>")
    pick = lambda k: F.coalesce(parsed[k], F.lit("")).alias(k)
    return bd.table(spark, sf, "events").select("event_id", pick("host"), pick("component"), pick("scenario_id"), pick("phase"))


# ---- templates and tokens ----------------------------------------------------------------------


def _templated(spark, sf):
    return tp.with_template(bd.log_lines(spark, sf))


def _document_templates(spark, sf):
    lines = bd.text_lines_of_documents(spark, sf)
    return tp.with_template(lines, "line").withColumn("label", F.lit(0))


def _document_dictionary(spark, sf):
    return tp.fit_dictionary(_document_templates(spark, sf))


@query
def template_dictionary(spark, sf):
    both = _templated(spark, sf).select("template_text").unionByName(_document_templates(spark, sf).select("template_text"))
    return tp.fit_dictionary(both)


@query
def assign_templates(spark, sf):
    # fitted on the log lines that carry no error, so the templates of errors are unseen
    mined = materialise(_templated(spark, sf).select("line_no", "label", "template_text"), "templated")
    return tp.lookup_ids(mined, tp.fit_dictionary(mined.where(F.col("label") == 0))).select("line_no", "template_id")


@query
def template_stats(spark, sf):
    stats = materialise(tp.template_stats(_templated(spark, sf)), "stats")
    ids = tp.fit_dictionary(stats)
    return ids.join(stats, "template_text").select("template_id", "template_text", "count", _r("anomaly_rate").alias("anomaly_rate"))


@query
def templates_per_source(spark, sf):
    docs = _document_templates(spark, sf).join(bd.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return tp.templates_per_source(docs, "source")


@query
def top_templates(spark, sf):
    return tp.top_templates(tp.template_stats(_document_templates(spark, sf)), 20).select("template_text", "count")


@query
def template_freq_buckets(spark, sf):
    return tp.frequency_buckets(tp.template_stats(_document_templates(spark, sf)))


def _event_dictionary(spark, sf):
    return tp.fit_dictionary(bd.event_stream(spark, sf))


@query
def encode_tokens(spark, sf):
    ids = bd.table(spark, sf, "events").select("event_id", (F.col("event_id") % 9).cast("int").alias("template_id"))
    return tp.encode(ids, _event_dictionary(spark, sf)).select("event_id", "template_id", F.col("token_id").cast("int").alias("token_id"))


@query
def decode_tokens(spark, sf):
    tokens = bd.table(spark, sf, "events").select("event_id", (F.col("event_id") % 10).cast("int").alias("token_id"))
    return tp.decode(tokens, _event_dictionary(spark, sf)).select(
        "event_id", "token_id", F.coalesce("template_id", F.lit(-1)).alias("template_id"), "text"
    )


@query
def vocab_table(spark, sf):
    return tp.vocabulary(_event_dictionary(spark, sf))


@query
def raw_to_token(spark, sf):
    fitted = tp.fit_dictionary(_templated(spark, sf).where(F.col("label") == 0))
    return tp.raw_to_token(bd.log_lines(spark, sf), fitted).select("line_no", "token_id")


@query
def template_families(spark, sf):
    families = tp.template_families(_document_dictionary(spark, sf))
    return families.select("family", "part", F.size("tokens").alias("n"), _join("tokens").alias("tokens"))


# ---- sessions and sequences --------------------------------------------------------------------


@query
def session_sequences(spark, sf):
    out = sq.session_sequences(bd.token_stream(spark, sf), ORDER)
    return out.select("session_id", "dataset", "label", "sequence_length", "unique_template_count", "part", _join("tokens").alias("sequence"))


@query
def session_sequences_orders(spark, sf):
    out = sq.session_chunks(bd.order_tokens(spark, sf), ["session_id"], bd.ORDER_ITEMS, "template_id")
    return out.select("session_id", "part", _join("tokens").alias("sequence"))


@query
def label_sessions(spark, sf):
    docs = bd.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("session_id"), "source")
    truth = bd.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("session_id"), F.col("toxic").alias("label"))
    return sq.label_sessions(docs, truth)


@query
def union_sources(spark, sf):
    logs = bd.log_lines(spark, sf).select(F.col("line_no").alias("id"), F.lit("log").alias("dataset"), "message", "label")
    talks = bd.table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.lit("talk").alias("dataset"), F.col("text").alias("message"))
    return sq.union_sources(logs, talks).select("id", "dataset", "message", F.coalesce("label", F.lit(-1)).alias("label"))


@query
def sliding_sequences(spark, sf):
    out = sq.sliding_sequences(bd.token_stream(spark, sf), ORDER, 50, 10)
    return out.select("sequence_id", _join("tokens").alias("tokens"), "label", F.size("timestamps").alias("n_timestamps"))


@query
def sliding_sequences_by_session(spark, sf):
    out = sq.sliding_sequences(bd.token_stream(spark, sf), ORDER, 60, 20, keys=["session_id"])
    return out.select("session_id", "sequence_id", _join("tokens").alias("tokens"), "label")


@query
def parse_sequences(spark, sf):
    sessions = sq.session_sequences(bd.token_stream(spark, sf), ORDER)
    blank = F.when(F.col("label") == 0, " ").when(F.col("sequence_length") % 5 == 0, F.lit(None).cast("string"))
    stored = sessions.select("session_id", blank.otherwise(_join("tokens")).alias("ordered_template_sequence"))
    return sq.parse_sequences(stored).select("session_id", F.size("tokens").alias("n"), F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + t).alias("total"))


def _vectors(spark, sf):
    return bd.table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") != 0).cast("int").alias("label"))


@query
def embedding_windows(spark, sf):
    out = sq.embedding_windows(_vectors(spark, sf), [], ["vec_id"], 10, 5)
    flat = F.flatten("vectors")
    total = F.aggregate(flat, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("start", F.size("vectors").alias("n"), F.size(flat).alias("n_values"), _r(total, 4).alias("total"), "label")


@query
def window_label_counts(spark, sf):
    return sq.window_label_counts(sq.embedding_windows(_vectors(spark, sf), [], ["vec_id"], 10, 5))


@query
def session_windows(spark, sf):
    out = sq.session_windows(bd.token_stream(spark, sf), ORDER, 20)
    return out.select("session_id", "start", _join("tokens").alias("tokens"))


@query
def thinned_windows(spark, sf):
    out = sq.thinned_windows(bd.token_stream(spark, sf), ORDER, 20, target=1000)
    return out.select("start", "stride", _join("tokens").alias("tokens"))


@query
def stratified_sample(spark, sf):
    logs = bd.log_lines(spark, sf)
    return sm.stratified_sample(logs, ["label", "service"], "line_no", logs.count() // 10).select("line_no", "label", "service")


@query
def sample_report(spark, sf):
    logs = bd.log_lines(spark, sf)
    sample = sm.stratified_sample(logs, ["label", "service"], "line_no", logs.count() // 10)
    return sm.sample_report(logs, sample, ["label", "service"]).withColumn("fraction", _r("fraction"))


@query
def split_stratified(spark, sf):
    return sm.split_stratified(bd.log_lines(spark, sf), "line_no").select("line_no", "label", "split")


@query
def split_by_time(spark, sf):
    return sq.split_by_time(bd.log_lines(spark, sf), ORDER, 0.15, 0.1).select("line_no", "split")


@query
def token_corpus(spark, sf):
    tokens = bd.token_stream(spark, sf)
    parts = sq.session_chunks(tokens, ["session_id"], ORDER, "token_id")
    sequences = sq.session_chunks(bd.role_tokens(spark, sf), ["session_id"], ["line_no"], "template_id")
    corpus = sq.token_corpus(sequences, parts, tp.template_families(_document_dictionary(spark, sf)))
    return corpus.select("source", F.size("tokens").alias("n"), F.concat_ws(" ", "tokens").alias("sentence"))


@query
def first_n_events(spark, sf):
    return sq.first_n_events(bd.log_lines(spark, sf), ORDER, 500).select("line_no", "service", "label")


def _truth(spark, sf):
    return bd.token_stream(spark, sf).groupBy("session_id").agg(
        (F.avg("label") > 0.25).cast("int").alias("label")
    )


@query
def select_sessions(spark, sf):
    tokens = bd.token_stream(spark, sf)
    chosen = sq.select_sessions(tokens, _truth(spark, sf), 10, 60)
    kept = sq.keep_sessions(tokens, chosen).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_events"))
    return chosen.join(kept, "session_id")


@query
def phase_labels(spark, sf):
    logs = bd.log_lines(spark, sf)
    return sq.phase_labels(logs, ["session_id"], ORDER).select(
        "line_no", "phase", _r("progress").alias("progress"), "phase_label", "phase_session"
    )


# ---- session features --------------------------------------------------------------------------


@query
def session_scalars(spark, sf):
    return ft.session_scalars(ft.token_counts(bd.token_stream(spark, sf))).withColumn("unique_ratio", _r("unique_ratio"))


@query
def session_entropy(spark, sf):
    counts = ft.token_counts(bd.token_stream(spark, sf))
    plain = ft.session_entropy(counts).select("session_id", _r("template_entropy").alias("entropy"))
    runtime = ft.session_entropy(counts, runtime=True).select("session_id", _r("template_entropy").alias("runtime_entropy"))
    return plain.join(runtime, "session_id")


@query
def topk_vocab(spark, sf):
    return ft.topk_vocab(ft.token_counts(bd.order_tokens(spark, sf)), 3)


def _steps(spark, sf):
    return ft.session_steps(bd.token_stream(spark, sf), ORDER)


def _long(spark, sf):
    steps = _steps(spark, sf)
    return ft.FeatureModel.fit(steps, 3, 5).transform(steps)


@query
def tid_features(spark, sf):
    return _long(spark, sf).where(F.col("feature").startswith("tid_")).withColumn("value", _r("value"))


@query
def bigram_counts(spark, sf):
    return ft.bigram_counts(_steps(spark, sf))


@query
def bigram_counts_orders(spark, sf):
    return ft.transition_counts(ft.session_steps(bd.order_tokens(spark, sf), bd.ORDER_ITEMS))


@query
def top_bigrams(spark, sf):
    top = ft.top_bigrams(_steps(spark, sf), 10)
    return top.select(ft.bigram_name(F.col("token"), F.col("next_token")).alias("bigram"), "cnt")


@query
def bigram_features(spark, sf):
    return _long(spark, sf).where(F.col("feature").startswith("bgram_")).withColumn("value", _r("value"))


@query
def session_features(spark, sf):
    steps = _steps(spark, sf)
    fitted = ft.FeatureModel.fit(steps, 3, 0)
    wide = fitted.wide(fitted.transform(steps))
    ranked = {f"f{i}": _r(c) for i, c in enumerate(wide.columns[1:])}
    return wide.select("session_id", *[c.alias(n) for n, c in ranked.items()])


@query
def features_fit_transform(spark, sf):
    steps = _steps(spark, sf)
    split = _session_split(steps)
    train = steps.join(split.where(F.col("split") == "train"), "session_id", "left_semi")
    rest = steps.join(split.where(F.col("split") != "train"), "session_id", "left_semi")
    return ft.FeatureModel.fit(train, 2, 4).transform(rest).withColumn("value", _r("value"))


def _session_split(steps):
    sessions = steps.select("session_id").distinct().withColumn("label", F.lit(0))
    return sm.split_stratified(sessions, "session_id", val_ratio=0.2, test_ratio=0.2)


@query
def session_summary(spark, sf):
    tokens = bd.order_tokens(spark, sf)
    counts = ft.token_counts(tokens)
    return ft.session_summary(ft.session_scalars(counts), counts).withColumn("mean_length", _r("mean_length"))


@query
def longest_sessions(spark, sf):
    return ft.longest_sessions(ft.session_scalars(ft.token_counts(bd.order_tokens(spark, sf)))).select("session_id", "sequence_length")


@query
def session_distributions(spark, sf):
    sessions = sq.session_summary_columns(bd.token_stream(spark, sf), ORDER)
    return ft.distribution(sessions, "label").unionByName(ft.distribution(sessions, "dataset"))


@query
def feature_totals(spark, sf):
    return ft.feature_totals(_long(spark, sf))


@query
def token_embeddings(spark, sf):
    parts = sq.session_chunks(bd.token_stream(spark, sf), ["session_id"], ORDER, "token_id")
    return vc.token_embeddings(parts.select(F.col("tokens").cast("array<string>").alias("tokens")), dim=16, epochs=3)


#: Dimensions of the vectors in ``embeddings``.
WIDTH = 64


def _given_vectors(spark, sf, width=8):
    """A vector for most tokens: the mean embedding of the label with the same number."""
    dims = [F.avg(F.col("embedding")[i].cast("double")).alias(f"d{i}") for i in range(width)]
    means = bd.table(spark, sf, "embeddings").groupBy((F.col("label") + 3).alias("token")).agg(*dims)
    return means.where(F.col("token") != 4).select("token", F.array(*[f"d{i}" for i in range(width)]).alias("vector"))


def _rounded(vectors):
    """Vectors rounded once per token, not once per event."""
    return vectors.withColumn("vector", F.transform("vector", lambda x: _r(x)))


@query
def mean_pool(spark, sf):
    pooled = vc.mean_pool(bd.token_stream(spark, sf), ["session_id"], "token_id", _given_vectors(spark, sf), 8)
    return pooled.select("session_id", *[_r(F.col("vector")[i]).alias(f"v{i}") for i in range(8)])


@query
def embed_tokens(spark, sf):
    out = vc.embed_tokens(bd.token_stream(spark, sf), _rounded(_given_vectors(spark, sf)), "token_id", 8)
    return out.select("line_no", "token_id", *[F.col("vector")[i].alias(f"v{i}") for i in (0, 7)])


@query
def mean_pool_whole(spark, sf):
    """All dimensions of ``mean_pool``."""
    pooled = vc.mean_pool(bd.token_stream(spark, sf), ["session_id"], "token_id", _given_vectors(spark, sf, WIDTH), WIDTH)
    return pooled.select("session_id", *[_r(F.col("vector")[i]).alias(f"v{i}") for i in range(WIDTH)])


@query
def embed_tokens_whole(spark, sf):
    """All dimensions of ``embed_tokens``."""
    out = vc.embed_tokens(bd.token_stream(spark, sf), _rounded(_given_vectors(spark, sf, WIDTH)), "token_id", WIDTH)
    return out.select("line_no", "token_id", *[F.col("vector")[i].alias(f"v{i}") for i in range(WIDTH)])


# ---- scoring -----------------------------------------------------------------------------------


def _embedding_features(spark, sf):
    return bd.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") != 0).cast("int").alias("label"),
    )


def _session_vectors(spark, sf):
    return flows.session_feature_vectors(bd.token_stream(spark, sf), ORDER, 5, 25)


@query
def iforest_fit(spark, sf):
    return md.iforest_fit(_session_vectors(spark, sf), "session_id", "features", trees=50)


@query
def iforest_score(spark, sf):
    vectors = materialise(_session_vectors(spark, sf), "vectors")
    nodes = md.iforest_fit(vectors, "session_id", "features", trees=100)
    return md.iforest_score(vectors, nodes, "features").select("session_id", "score")


@query
def contamination_sweep(spark, sf):
    scores = bd.scores(spark, sf)
    quality = evl.average_precision(scores).withColumnRenamed("average_precision", "pr_auc").scalar()
    out = th.contamination_labels(scores, [0.05, 0.10, 0.20])
    return out.select("contamination", _r("threshold").alias("threshold"), "n_flagged", "n_true", _r(quality).alias("pr_auc"))


def _transition_parts(spark, sf):
    tokens = bd.token_stream(spark, sf)
    steps = ft.session_steps(tokens, ORDER)
    vocab = steps.select("token").distinct()
    model = materialise(tr.transition_model(ft.transition_counts(steps), vocab), "transitions")
    return tokens, steps, vocab, model


@query
def transition_model(spark, sf):
    _, _, _, model = _transition_parts(spark, sf)
    return model.select("token", "next_token", "cnt", "from_cnt", _r("prob").alias("prob"))


@query
def next_token_nll(spark, sf):
    _, steps, vocab, model = _transition_parts(spark, sf)
    out = tr.next_token_nll(steps.select("session_id").distinct(), ft.bigram_counts(steps), model, vocab)
    return out.select("session_id", _r("mean_nll").alias("mean_nll"), _r("max_nll").alias("max_nll"))


@query
def validation_loss(spark, sf):
    steps = _steps(spark, sf)
    parted = steps.join(_session_split(steps).select("session_id", "split"), "session_id")
    counts = lambda name: ft.transition_counts(parted.where(F.col("split") == name))
    losses = tr.validation_loss(counts("train"), counts("val"), steps.select("token").distinct(), [0.01, 0.1, 1.0, 10.0])
    return losses.select("alpha", _r("loss").alias("loss"))


@query
def top_predictions(spark, sf):
    tokens, _, _, model = _transition_parts(spark, sf)
    return tr.top_predictions(tokens, ORDER, model, _event_dictionary(spark, sf), 3)


@query
def context_vector(spark, sf):
    cut = sq.embedding_windows(_vectors(spark, sf), [], ["vec_id"], 10, 5)
    context = vc.context_vector(F.col("vectors"), 64)
    return cut.select("start", context.alias("c")).select("start", *[_r(F.col("c")[i]).alias(f"c{i}") for i in (0, 31, 63)])


@query
def context_vector_whole(spark, sf):
    """All dimensions of ``context_vector``."""
    cut = sq.embedding_windows(_vectors(spark, sf), [], ["vec_id"], 10, 5)
    context = vc.context_vector(F.col("vectors"), WIDTH)
    return cut.select("start", context.alias("c")).select("start", *[_r(F.col("c")[i]).alias(f"c{i}") for i in range(WIDTH)])


def _reconstructed(spark, sf):
    rows = _embedding_features(spark, sf)
    model = vc.fit_reconstruction(rows.where(F.col("label") == 0), "features", 8)
    return vc.reconstruction(rows, model, "features")


@query
def reconstruction_error(spark, sf):
    return _reconstructed(spark, sf).select("row_id", "label", "error", "latent_norm")


@query
def severity_model(spark, sf):
    rows = materialise(th.severity_terciles(_reconstructed(spark, sf), "error").withColumn("features", F.concat("latent", F.array("error"))), "severity")
    model = md.fit_severity(rows, "features", 9)
    return md.classify_severity(rows, model, "features").select("row_id", "severity", "severity_label", "confidence", "probabilities")


def _split_vectors(spark, sf):
    split = sm.split_stratified(_embedding_features(spark, sf), "row_id", val_ratio=0.2, test_ratio=0.2)
    return materialise(split, "split")


@query
def logreg_scores(spark, sf):
    rows = _split_vectors(spark, sf)
    model = md.fit_logreg(rows.where(F.col("split") == "train"))
    return md.score_supervised(rows, model, "score").select("row_id", "label", "split", "score")


@query
def gbt_scores(spark, sf):
    rows = _split_vectors(spark, sf)
    model = md.fit_gbt(rows.where(F.col("split") == "train"), iterations=5, depth=4)
    return md.score_supervised(rows, model, "score").select("row_id", "label", "split", "score")


@query
def select_model(spark, sf):
    scores = bd.scores(spark, sf).select("label", F.col("score").alias("model_a"), F.col("score_b").alias("model_b"))
    out = evl.select_model(scores, ["model_a", "model_b"])
    return out.select("model", _r("average_precision").alias("average_precision"), _r("roc_auc").alias("roc_auc"), "rank")


def _model_scores(spark, sf):
    pairs = F.array(
        F.struct(F.lit("a").alias("model"), F.col("score").alias("s")), F.struct(F.lit("b").alias("model"), F.col("score_b").alias("s"))
    )
    return bd.scores(spark, sf).select("item_id", "label", F.inline(pairs)).withColumnRenamed("s", "score")


@query
def ensemble_score(spark, sf):
    long = _model_scores(spark, sf)
    out = th.ensemble_score(long, th.percentile_threshold(long, 95.0, ["model"]), ["item_id"])
    return out.select("item_id", _r("score").alias("score"), (_r("score") >= 1.0).alias("is_anomaly"))


@query
def decide(spark, sf):
    scores = bd.scores(spark, sf)
    limit = th.percentile_threshold(scores, 95.0).scalar()
    return scores.select(
        "item_id", al.decide(F.col("score"), limit).alias("at_least"), al.decide(F.col("score"), limit, strict=True).alias("above"),
        al.decide(F.col("score"), F.lit(0.0), strict=True).alias("uncalibrated"),
    )


@query
def score_with_fallback(spark, sf):
    items = bd.scores(spark, sf).select("item_id", "label")
    known = bd.scores(spark, sf).where(F.col("label") == 0)
    return th.score_with_fallback(items, known, ["item_id"], 2.0)


@query
def severity_terciles(spark, sf):
    return th.severity_terciles(bd.scores(spark, sf)).select("item_id", "severity")


# ---- thresholds and evaluation -----------------------------------------------------------------


@query
def f1_threshold(spark, sf):
    return _metric_digits(th.f1_threshold(bd.scores(spark, sf)))


def _metric_digits(df):
    return df.withColumns({c: _r(c) for c in ("threshold", "f1", "precision", "recall", "pct_pred")})


@query
def threshold_by_group(spark, sf):
    return _metric_digits(th.f1_threshold(bd.scores(spark, sf), ["service"]))


def _both(spark, sf):
    scores = bd.scores(spark, sf)
    overall = th.f1_threshold(scores)
    return th.predict_both(scores, overall, th.f1_threshold(scores, ["service"]), "service")


@query
def predictions_by_group(spark, sf):
    return _both(spark, sf).select("item_id", "pred_overall", "pred_by_group")


@query
def percentile_threshold(spark, sf):
    return th.percentile_threshold(bd.scores(spark, sf), 95.0, ["service"]).withColumn("threshold", _r("threshold"))


@query
def runtime_threshold(spark, sf):
    long = _model_scores(spark, sf).withColumn("label", F.when(F.col("model") == "a", F.col("label")))
    some = bd.scores(spark, sf).select("item_id", F.lit("c").alias("model"), (F.col("score") * F.col("score")).alias("score"),
                                       (F.col("score") > 100).cast("int").alias("label"))
    out = th.runtime_threshold(long.select("item_id", "model", "score", "label").unionByName(some.select("item_id", "model", "score", "label")), ["model"], 0.02)
    return out.withColumn("threshold", _r("threshold"))


@query
def score_stats(spark, sf):
    long = _model_scores(spark, sf)
    out = th.score_stats(long, ["model"], th.percentile_threshold(long, 95.0, ["model"]))
    return out.select("model", *[_r(c).alias(c) for c in ("min", "p50", "p95", "p99", "max", "alert_rate")])


def _predicted(spark, sf):
    scores = bd.scores(spark, sf)
    limit = th.percentile_threshold(scores, 95.0).scalar()
    pred = F.when(F.col("score_b") > 5, (F.col("score") >= limit).cast("int"))
    label = F.when(F.col("score_b") < 90, F.col("label"))
    return scores.withColumn("pred", pred).withColumn("label", label)


RATES = ["precision", "recall", "f1", "fpr", "pct_pred"]


@query
def confusion_metrics(spark, sf):
    out = evl.confusion_metrics(_predicted(spark, sf), ["service"])
    return out.withColumns({c: _r(c) for c in RATES})


@query
def roc_auc(spark, sf):
    return evl.roc_auc(bd.scores(spark, sf), ["service"]).withColumn("roc_auc", _r("roc_auc"))


@query
def average_precision(spark, sf):
    return evl.average_precision(bd.scores(spark, sf), ["service"]).withColumn("average_precision", _r("average_precision"))


@query
def curve_points(spark, sf):
    out = evl.curve_points(bd.scores(spark, sf), ["service"])
    return out.withColumns({c: _r(c) for c in ("fpr", "recall", "precision")})


@query
def score_histogram(spark, sf):
    out = evl.score_histogram(bd.scores(spark, sf), 59)
    return out.withColumns({c: _r(c) for c in ("bin_start", "density")})


@query
def eval_by_group(spark, sf):
    out = evl.eval_by_group(_both(spark, sf), "service", ["pred_overall", "pred_by_group"])
    return out.withColumns({c: _r(c) for c in RATES})


@query
def class_report(spark, sf):
    rows = bd.scores(spark, sf).withColumn("pred", (F.col("score_b") >= 50).cast("int"))
    return evl.class_report(rows).withColumns({c: _r(c) for c in ("precision", "recall", "f1")})


def _window_flags(spark, sf):
    cut = wn.rolling_windows(sq.keyed(bd.token_stream(spark, sf)), ORDER, 60, 5)
    hits = F.size(F.filter("tokens", lambda t: t == 4))
    return cut.select(F.element_at(F.split("stream_key", ":"), 2).alias("session_id"), (hits >= 14).alias("is_anomaly"))


@query
def session_verdict(spark, sf):
    sessions = bd.token_stream(spark, sf).select("session_id").distinct()
    out = evl.session_verdict(sessions, _window_flags(spark, sf))
    return out.select("session_id", F.coalesce(F.col("raw_verdict").cast("int"), F.lit(-1)).alias("raw_verdict"), "pred")


@query
def compare_runs(spark, sf):
    rows = bd.scores(spark, sf)
    names = ["tp", "fp", "tn", "fn", "precision", "recall", "f1", "fpr"]
    a = evl.confusion_metrics(rows.withColumn("pred", (F.col("score") >= 100).cast("int")))
    b = evl.confusion_metrics(rows.withColumn("pred", (F.col("score_b") >= 50).cast("int")))
    out = evl.compare_runs(evl.metric_rows(a, names), evl.metric_rows(b, names))
    return out.withColumns({c: _r(c) for c in ("value_a", "value_b", "delta")})


@query
def latency_summary(spark, sf):
    out = evl.latency_summary(bd.scores(spark, sf), "score", "timestamp", "label", ["service"])
    return out.withColumns({c: _r(c) for c in ("mean_latency", "events_per_sec", "anomaly_rate_pct", "p95_latency")})


@query
def dq_report(spark, sf):
    logs = sq.phase_labels(bd.log_lines(spark, sf), ["session_id"], ORDER)
    return evl.dq_report(logs, "label", "message", "timestamp", "phase", ["normal", "degradation", "failure"])


@query
def distribution_report(spark, sf):
    return evl.distribution_report(bd.log_lines(spark, sf), "service").withColumn("label_rate", _r("label_rate"))


@query
def first_messages(spark, sf):
    return evl.first_messages(bd.log_lines(spark, sf), "service", ORDER, "message", 3)


# ---- windows and alerts ------------------------------------------------------------------------


@query
def rolling_windows(spark, sf):
    out = wn.rolling_windows(sq.keyed(bd.token_stream(spark, sf)), ORDER, 50, 10)
    return _window_rows(out)


def _window_rows(out):
    return out.select(
        "stream_key", "sequence_id", F.col("emit_index").cast("bigint").alias("emit_index"), _join("tokens").alias("tokens"), "label",
        _r(F.element_at("timestamps", 1)).alias("start_ts"), _r(F.element_at("timestamps", -1)).alias("end_ts"),
    )


def _short_windows(spark, sf):
    return wn.rolling_windows(sq.keyed(bd.token_stream(spark, sf)), ORDER, 10, 5)


@query
def evidence_window(spark, sf):
    out = wn.template_previews(wn.evidence(_short_windows(spark, sf)), _event_dictionary(spark, sf), ["stream_key", "emit_index"])
    e = F.col("evidence_window")
    return out.select(
        "sequence_id", _join(e["tokens"]).alias("tokens"), _join(e["template_ids"]).alias("template_ids"),
        F.concat_ws("|", "templates_preview").alias("previews"), _r(e["window_start_ts"]).alias("start_ts"), _r(e["window_end_ts"]).alias("end_ts"),
    )


def _risk_items(spark, sf):
    """Every event as a risk row: value against the 80th percentile of normal values."""
    scores = bd.scores(spark, sf)
    limit = th.percentile_threshold(scores, 80.0).scalar()
    return scores.withColumn("stream_key", ev.stream_key(F.col("service"), F.col("session_id"))).select(
        "stream_key", "timestamp", "item_id", F.col("score").alias("risk_score"), limit.alias("threshold"),
        (F.col("score") >= limit).alias("is_anomaly"), (F.col("score_b") % 10).cast("int").alias("window_size"),
    )


@query
def risk_results(spark, sf):
    risks, _ = flows.windowed_alerts(bd.token_stream(spark, sf), 10, 5)
    return risks.select("stream_key", "emit_number", "model", "risk_score", _r("threshold").alias("threshold"), "is_anomaly", "window_size", "label")


@query
def alert_gate(spark, sf):
    return al.alert_gate(_risk_items(spark, sf), min_score=90.0, min_events=3).select("item_id", "risk_score")


@query
def alert_severity(spark, sf):
    custom = {"page": 3.0, "mail": 0.5}
    return _risk_items(spark, sf).select(
        "item_id", ev.severity_by_ratio(F.col("risk_score"), F.col("threshold")).alias("severity"),
        ev.severity_by_ratio(F.col("risk_score"), F.col("threshold"), custom).alias("custom"),
    )


def _flagged(spark, sf):
    gated = al.alert_gate(_risk_items(spark, sf)).withColumn("emit_index", F.col("item_id"))
    return al.cooldown(gated, "stream_key", ["timestamp", "item_id"], 86400.0)


@query
def alert_cooldown(spark, sf):
    return _flagged(spark, sf).select("stream_key", "item_id", "fired")


@query
def suppressed_counts(spark, sf):
    return al.suppressed_counts(_flagged(spark, sf), "stream_key")


@query
def alerts(spark, sf):
    fired = _alerts(spark, sf)
    return fired.select("alert_id", "severity", "service", "score", F.col("evidence_window.token_count").alias("token_count"),
                        F.concat_ws("|", "evidence_window.templates_preview").alias("previews"), F.col("meta.stream_key").alias("stream_key"), F.col("meta.emit_index").alias("emit_index"))


def _alerts(spark, sf):
    _, flagged = flows.windowed_alerts(bd.token_stream(spark, sf), 10, 5, cooldown_seconds=86400.0)
    fired = wn.template_previews(flagged.where("fired"), _event_dictionary(spark, sf), ["stream_key", "emit_index"])
    return al.alerts(fired, ["stream_key", "emit_number"])


@query
def windowed_alerts(spark, sf):
    _, flagged = flows.windowed_alerts(bd.token_stream(spark, sf), 50, 10, percentile=80.0, cooldown_seconds=86400.0)
    return flagged.select(
        "stream_key", "emit_number", "risk_score", "label",
        ev.severity_by_ratio(F.col("risk_score"), F.col("threshold")).alias("severity"), "fired",
    )


def _fitted(spark, sf) -> tuple[af.Artefacts, DataFrame]:
    """The flow fitted to the earlier half of the events, saved and loaded again, and the later events."""
    parts = sq.split_by_time(bd.event_stream(spark, sf), ORDER, 0.1, 0.4)
    folder = _folder(spark, "artefacts")
    online.fit(parts.where("split = 'train'").drop("split"), folder, 10, 5, percentile=80.0)
    return af.load(spark.newSession(), folder), parts.where("split = 'test'").drop("split")


def _applied_rows(flagged: DataFrame) -> DataFrame:
    severity = ev.severity_by_ratio(F.col("risk_score"), F.col("threshold")).alias("severity")
    return flagged.select("stream_key", "emit_index", "risk_score", "label", severity, "fired")


@query
def windowed_alerts_apply(spark, sf):
    model, later = _fitted(spark, sf)
    return _applied_rows(online.apply(later, model, 86400.0))


@query
def windowed_alerts_fallback(spark, sf):
    """Nothing was saved: every window has the constant score and says why."""
    events = bd.event_stream(spark, sf)
    flagged = online.apply(events, af.load(spark, _folder(spark, "none")), 86400.0, 0.5, 0.5, window=10, stride=5)
    return flagged.select("stream_key", "emit_index", "risk_score", "fallback_reason", "label", "fired")


@query
def recent_alerts(spark, sf):
    fired = _flagged(spark, sf).where("fired")
    return al.recent_alerts(fired, [F.desc("timestamp"), F.desc("item_id")], 50).select("item_id", "stream_key")


@query
def recent_alerts_per_key(spark, sf):
    fired = _flagged(spark, sf).where("fired")
    return al.recent_alerts_per_key(fired, "stream_key", [F.desc("timestamp"), F.desc("item_id")], 3).select("item_id", "stream_key")


@query
def alert_message(spark, sf):
    risks = _risk_items(spark, sf).where("is_anomaly")
    service = F.element_at(F.split("stream_key", ":"), 1)
    severity = ev.severity_by_ratio(F.col("risk_score"), F.col("threshold"))
    return risks.select("item_id", al.alert_message(service, severity, F.col("risk_score"), F.col("window_size") / 16.0).alias("message"))


@query
def active_keys(spark, sf):
    return wn.active_keys(sq.keyed(bd.token_stream(spark, sf)), 20, order=ORDER)


@query
def run_counters(spark, sf):
    risks, _ = flows.windowed_alerts(bd.token_stream(spark, sf), 10, 5)
    return al.run_counters(sq.keyed(bd.token_stream(spark, sf)), risks)


@query
def raw_line_alerts(spark, sf):
    return flows.raw_line_alerts(bd.log_lines(spark, sf), cooldown_seconds=3600.0)


@query
def alerts_v2(spark, sf):
    """Class severity, confidence and cooldown on given scores: the deterministic part of the raw-line flow."""
    scores = th.severity_terciles(bd.scores(spark, sf))
    limit = th.percentile_threshold(bd.scores(spark, sf), 80.0).scalar()
    keyed = scores.withColumn("stream_key", ev.path_key(F.col("service"), F.col("session_id")))
    hits = keyed.where(al.decide(F.col("score"), limit, strict=True)).select(
        "stream_key", "timestamp", "item_id", "score",
        F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("critical")), F.col("severity") + 1).alias("severity"),
        (F.col("score_b") / 100).alias("confidence"),
    )
    fired = al.cooldown(hits, "stream_key", ["timestamp", "item_id"], 43200.0).where("fired")
    return fired.select("item_id", "stream_key", "severity", "score", "confidence")


# ---- operational metrics -----------------------------------------------------------------------

HOUR = 3600


def _counters(spark, sf):
    return bd.scores(spark, sf).withColumn("one", F.lit(1).cast("bigint"))


@query
def increase_5m(spark, sf):
    sums = {"events": F.lit(1).cast("bigint"), "errors": F.col("label").cast("bigint")}
    return om.increase(_counters(spark, sf), "timestamp", ["service"], sums, 5 * HOUR, HOUR)


@query
def error_rate_5m(spark, sf):
    out = om.increase(_counters(spark, sf), "timestamp", ["service"], {"errors": F.col("label").cast("bigint")}, 5 * HOUR, HOUR)
    return out.select("service", "step_start", _r(F.col("errors") / (5 * HOUR), 9).alias("error_rate"))


@query
def alerts_by_severity(spark, sf):
    risks = _risk_items(spark, sf).withColumn("severity", ev.severity_by_ratio(F.col("risk_score"), F.col("threshold")))
    return al.alerts_by_severity(risks)


@query
def latency_buckets(spark, sf):
    out = om.latency_histogram(bd.scores(spark, sf), F.col("score") / 1000, ["service"])
    return out.select("service", F.col("le").cast("string").alias("le"), "cumulative")


@query
def bucket_quantile(spark, sf):
    buckets = om.latency_histogram(bd.scores(spark, sf), F.col("score") / 1000, ["service"])
    return om.bucket_quantile(buckets, 0.95, ["service"]).select("service", _r("quantile").alias("p95"))


@query
def mean_latency_5m(spark, sf):
    sums = {"total_cents": F.round(F.col("score") * 100).cast("bigint"), "n": F.lit(1).cast("bigint")}
    out = om.increase(_counters(spark, sf), "timestamp", ["service"], sums, 5 * HOUR, HOUR)
    mean = F.coalesce(F.col("total_cents") / F.nullif(F.col("n"), F.lit(0)) / 100, F.lit(0.0))
    return out.select("service", "step_start", _r(mean).alias("mean_latency"))


@query
def sustained_condition(spark, sf):
    steps = om.increase(_counters(spark, sf), "timestamp", ["service"], {"errors": F.col("label").cast("bigint")}, 5 * HOUR, HOUR)
    return om.sustained(steps, ["service"], F.col("errors") >= 5, 2 * HOUR, HOUR)


@query
def stalled_streams(spark, sf):
    out = om.stalled(bd.scores(spark, sf), "timestamp", ["service"], 2 * HOUR, HOUR)
    return out.select("service", *[_r(c).alias(c) for c in ("stalled_from", "stalled_to", "gap_seconds")])


@query
def health_rollup(spark, sf):
    hourly = om.increase(_counters(spark, sf), "timestamp", ["service"], {"events": F.lit(1).cast("bigint"), "errors": F.col("label").cast("bigint")}, HOUR, HOUR)
    status = hourly.select(
        "service", (F.floor(F.col("step_start") / 86400) * 86400).alias("day"),
        (F.col("errors") * 2 <= F.col("events")).alias("engine_ok"), (F.col("events") >= 1).alias("manager_ok"), (F.col("events") < 12).alias("buffer_ok"),
    )
    return om.health_rollup(status, ["service", "day"], ["engine_ok"], ["manager_ok", "buffer_ok"])


@query
def keyword_topk(spark, sf):
    base = bd.table(spark, sf, "benchmark")
    text = F.concat_ws(" ", F.col("item_id").cast("string"), F.col("text"))
    return om.keyword_topk(bd.table(spark, sf, "documents"), "doc_id", "text", base, "item_id", text, 3)


@query
def keyword_answer(spark, sf):
    answers = [(w, F.lit(f"about {w}")) for w in ("error", "alert", "the", "der", "le")]
    return bd.table(spark, sf, "documents").select("doc_id", om.first_answer(F.col("text"), answers, F.lit("default")).alias("answer"))


# ---- streaming ---------------------------------------------------------------------------------


def _event_source(spark, sf):
    """Events as a file stream in the layout of the batch token stream, without template ids."""
    schema = bd.table(spark, sf, "events").schema
    raw = rd.stream_files(spark, sf, schema, pathGlobFilter="events.parquet")
    return bd.as_event_stream(raw)


def _token_source(spark, sf):
    return tp.lookup_ids(_event_source(spark, sf), _event_dictionary(spark, sf)).withColumn("token_id", F.col("template_id") + 2)


@query
def stream_events(spark, sf):
    typed = rd.token_events(_token_source(spark, sf).drop("label"))
    out = st_windows.run_to_table(typed, _folder(spark, "stream"), TOKEN_STREAM)
    return out.groupBy("service", "session_id", "token_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("n_labels"), _r(F.max("timestamp")).alias("last_ts")
    )


@query
def stream_rolling_windows(spark, sf):
    windows = st_windows.stream_windows(sq.keyed(_token_source(spark, sf)), 50, 10)
    out = st_windows.run_to_table(windows, _folder(spark, "stream"), windows.schema)
    return _window_rows(out)


@query
def stream_alert_cooldown(spark, sf):
    scores = th.percentile_threshold(bd.scores(spark, sf), 80.0)
    limit = scores.first()["threshold"]
    gated = sq.keyed(_event_source(spark, sf)).where(F.col("value") >= limit).select(
        "stream_key", "timestamp", F.col("line_no").alias("item_id")
    )
    flagged = st_alerts.stream_cooldown(gated, 86400.0)
    out = st_windows.run_to_table(flagged, _folder(spark, "stream"), flagged.schema)
    return out.select("stream_key", "item_id", "fired")


@query
def stream_windowed_alerts(spark, sf):
    model, later = _fitted(spark, sf)
    first = later.agg(F.min(F.struct(*ORDER)).alias("at")).first()["at"]
    since = F.struct(F.lit(first["timestamp"]).alias("timestamp"), F.lit(first["line_no"]).alias("line_no"))
    flagged = online.apply_stream(_event_source(spark, sf).where(F.struct(*ORDER) >= since), model, 86400.0)
    return _applied_rows(st_windows.run_to_table(flagged, _folder(spark, "stream"), flagged.schema))


@query
def stream_increase(spark, sf):
    counted = st_metrics.stream_increase(
        _event_source(spark, sf).withColumn("event_time", ev.epoch_to_timestamp(F.col("timestamp"))),
        "event_time", ["service"], {"events": F.lit(1).cast("bigint"), "errors": F.col("label").cast("bigint")}, "5 hours", "1 hour", "1 hour",
    )
    out = st_windows.run_to_table(counted, _folder(spark, "stream"), counted.schema, mode="complete")
    return out.select("service", F.unix_seconds("window_end").alias("window_end"), "events", "errors")


@query
def sink_alert_outbox(spark, sf):
    source = _folder(spark, "alerts")
    alerts_in = _alerts(spark, sf)
    alerts_in.write.parquet(source)
    path = _folder(spark, "outbox")
    stream = rd.stream_files(spark, source, alerts_in.schema)
    st_alerts.run_outbox(stream, path, _folder(spark, "state"))
    return sk.read_outbox(spark, path).select(
        "alert_id", F.get_json_object("document", "$.severity").alias("severity"), F.get_json_object("document", "$.service").alias("service"),
        F.get_json_object("document", "$.meta.stream_key").alias("stream_key"),
    )
