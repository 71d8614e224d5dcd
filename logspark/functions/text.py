"""Text expressions: template generalisation, cleaning, tokenising, line parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The results depend on these exact patterns, tags and their order.
TEMPLATE_PATTERNS = [
    (r"blk_-?\d+", "<BLK>"),
    (r"\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2}\.\d+", "<TS>"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?", "<IP>"),
    (r"\d{4}\.\d{2}\.\d{2}", "<DATE>"),
    (r"R\d+(?:-[A-Z\d]+)+(?::[A-Z]\d+-[A-Z]\d+)?", "<NODE>"),
    (r"/[a-zA-Z0-9_./-]+", "<PATH>"),
    (r"\b[0-9a-f]{8,}\b", "<HEX>"),
    (r"\b\d+\b", "<NUM>"),
    (r"\s+", " "),
]

# Cleaning patterns and tags, applied after lower-casing.
CLEAN_PATTERNS = [
    (r"blk_-?\d+", "[BLK]"),
    (r"\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2}\.\d+", "[TIMESTAMP]"),
    (r"\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}", "[TIMESTAMP]"),
    (r"\d{4}[-./]\d{2}[-./]\d{2}", "[TIMESTAMP]"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?", "[IP]"),
    (r"(?i)R\d+(?:-[A-Z0-9]+)+(?::[A-Z]\d+-[A-Z]\d+)?", "[NODE]"),
    (r"/[a-zA-Z0-9_./-]+", "[PATH]"),
    (r"\b[0-9a-fA-F]{8,}\b", "[HEX]"),
    (r"\b\d+\b", "[NUM]"),
    (r"\s+", " "),
]

# Service names that count as a prefix, and the token pattern.
SERVICE_PREFIX = r"^(hdfs|bgl|dfs|hadoop|namenode|datanode|jobtracker|tasktracker)[\s.:,]"
TOKEN_PATTERN = r"\[[A-Z]+\]|[\p{L}\p{N}_]+"

# Line layout. WARNING comes before WARN so that its tail is not left in the message.
LINE_PATTERN = (
    r"(?i)(\d{4}-\d{2}-\d{2}[\s\-]\d{2}[:.]\d{2}[:.]\d{2}[.\d]*)?"
    r"\s*(INFO|WARNING|WARN|ERROR|FATAL|DEBUG|TRACE)?\s*(.+)"
)

BLOCK_ID_PATTERN = r"(blk_-?\d+)"


def strip(c: Column) -> Column:
    """Drop leading and trailing ASCII white space of every kind, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _substitute(c: Column, patterns: list[tuple[str, str]]) -> Column:
    return reduce(lambda acc, p: F.regexp_replace(acc, p[0], p[1]), patterns, c)


def generalize(message: Column, patterns: list[tuple[str, str]] = TEMPLATE_PATTERNS) -> Column:
    """Template text of a raw message; null becomes the empty template."""
    return F.trim(_substitute(F.coalesce(message, F.lit("")), patterns))


def clean(message: Column) -> Column:
    """Lower-cased message with variable parts replaced by bracket tags."""
    lowered = strip(F.lower(message))
    return F.trim(_substitute(F.regexp_replace(lowered, SERVICE_PREFIX, "[SERVICE] "), CLEAN_PATTERNS))


def tokenize(cleaned: Column) -> Column:
    """Bracket tags and words of a cleaned message, in order."""
    return F.regexp_extract_all(cleaned, F.lit(TOKEN_PATTERN), F.lit(0))


def message_corpus(df: DataFrame, message: str = "message") -> DataFrame:
    """Add ``tokens`` of each message and drop messages without any.

    The empty ones are dropped by the generator; a filter would be pushed below and run all patterns twice.
    """
    found = F.filter(F.array(tokenize(clean(F.col(message)))), lambda t: F.size(t) > 0)
    return df.select("*", F.explode(found).alias("tokens"))


def parse_line(raw: Column) -> Column:
    """Struct ``(level, message)`` of a text log line; a leading timestamp is dropped."""
    line = strip(raw)
    body = F.regexp_extract(line, LINE_PATTERN, 3)
    return F.struct(
        F.upper(F.regexp_extract(line, LINE_PATTERN, 2)).alias("level"),
        strip(F.when(body == "", line).otherwise(body)).alias("message"),
    )


def parse_json(raw: Column, default_service: str = "") -> Column:
    """Struct of a JSON log line; aliases are resolved, other keys go to ``meta``, bad JSON to ``message``."""
    line = strip(raw)
    obj = F.from_json(line, "map<string,string>")
    known = ["timestamp", "ts", "level", "severity", "message", "msg", "label", "service"]
    return F.struct(
        F.coalesce(obj["timestamp"], obj["ts"]).try_cast("double").alias("timestamp"),
        F.coalesce(obj["service"], F.lit(default_service)).alias("service"),
        F.upper(F.coalesce(obj["level"], obj["severity"], F.lit(""))).alias("level"),
        F.coalesce(obj["message"], obj["msg"], line).alias("message"),
        obj["label"].try_cast("int").alias("label"),
        F.map_filter(
            F.coalesce(obj, F.create_map().cast("map<string,string>")),
            lambda k, _: ~k.isin(known),
        ).alias("meta"),
    )


def snippet(template_id: Column, text: Column, width: int = 100) -> Column:
    """Preview line of a template, cut at ``width`` characters."""
    text = F.coalesce(text, F.lit("<UNK>"))
    short = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)
    return F.concat(F.lit("tid="), template_id.cast("string"), F.lit(": "), short)
