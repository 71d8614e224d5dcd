"""Shared tables as logs: raw lines, token streams, session labels, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators.templates import fit_dictionary, lookup_ids
from logspark.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One shared Parquet table; times are read in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _epoch() -> F.Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw log line per event, with block id, address, path and numbers in the message."""
    user, event = F.col("user_id"), F.col("event_id")
    text = lambda c: c.cast("string")
    level = (
        F.when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "purchase", "WARN")
        .otherwise("INFO")
    )
    message = F.concat_ws(
        " ",
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"),
        level,
        F.col("event_type"),
        F.concat(F.lit("blk_"), text(event)),
        F.concat(F.lit("src 10.0."), text(user % 256), F.lit("."), text(event % 256), F.lit(":8080")),
        F.concat(F.lit("file /api/"), F.col("event_type"), F.lit("/"), text(user % 7)),
        F.concat(F.lit("retry "), text(user % 5)),
        F.concat(F.lit("value="), text(F.floor("value"))),
    )
    return table(spark, sf_dir, "events").select(
        event.alias("line_no"),
        _epoch().alias("timestamp"),
        F.concat(F.lit("svc-"), text(user % 4)).alias("service"),
        text(user).alias("session_id"),
        level.alias("level"),
        message.alias("message"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their type as template text, without ids."""
    return as_event_stream(table(spark, sf_dir, "events"))


def as_event_stream(events: DataFrame) -> DataFrame:
    """The same projection for a batch or a stream of events."""
    return events.select(
        F.col("event_id").alias("line_no"),
        _epoch().alias("timestamp"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")).alias("service"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_type").alias("template_text"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        "value",
    )


def token_stream(spark: SparkSession, sf_dir: str, dictionary: DataFrame | None = None) -> DataFrame:
    """Token per event: dense id of the event type plus the two reserved tokens."""
    events = event_stream(spark, sf_dir)
    dictionary = fit_dictionary(events, "template_text") if dictionary is None else dictionary
    return lookup_ids(events, dictionary, "template_text").withColumn("token_id", F.col("template_id") + 2)


def role_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions, roles as template texts."""
    talks = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("line_no"),
        F.col("role").alias("template_text"),
    )
    return lookup_ids(talks, fit_dictionary(talks, "template_text"), "template_text")


def order_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sessions by order; return flag and line status form the template text."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("session_id"),
        F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint").alias("day"),
        "l_linenumber", "l_partkey", "l_suppkey",
        F.concat("l_returnflag", "l_linestatus").alias("template_text"),
    )
    return lookup_ids(items, fit_dictionary(items, "template_text"), "template_text")


ORDER_ITEMS = ["day", "l_linenumber", "l_partkey", "l_suppkey"]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event value as anomaly score, error as label, the ``k`` property as a second score."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("item_id"),
        _epoch().alias("timestamp"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")).alias("service"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("value").alias("score"),
        F.get_json_object("props", "$.k").cast("double").alias("score_b"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


def text_lines_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, in order."""
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
