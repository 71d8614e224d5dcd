"""Template dictionary: fit, assign, encode, decode, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.text import generalize
from logspark.operators.ordering import dense_ids, top_k
from logspark.session import materialise, spread

PAD_ID, UNK_ID, OFFSET = 0, 1, 2  # fixed values: reserved tokens and the shift of template ids

# Upper-open frequency buckets, (label, lowest count).
FREQUENCY_BUCKETS = [
    ("1", 1), ("2-4", 2), ("5-9", 5), ("10-49", 10), ("50-99", 50), ("100-499", 100),
    ("500-999", 500), ("1k-4k", 1000), ("5k-9k", 5000), ("10k+", 10000),
]


def fit_dictionary(df: DataFrame, text: str = "template_text") -> DataFrame:
    """``template_id, template_text``: distinct texts in text order with dense ids from 1.

    The numbered texts are written, so that look-ups know their true size: a small dictionary is broadcast and
    events of a frequent template stay in place.
    """
    texts = df.select(F.col(text).alias("template_text")).where(F.col(text).isNotNull()).distinct()
    return materialise(dense_ids(texts, ["template_text"], "template_id").select("template_id", "template_text"), "dictionary")


def lookup_ids(df: DataFrame, dictionary: DataFrame, text: str = "template_text") -> DataFrame:
    """Add ``template_id`` by text, 0 for an unseen one.

    The dictionary is a written table: Catalyst broadcasts it when its files are small and otherwise
    joins by shuffle, where AQE splits the partitions of frequent templates.
    """
    ids = dictionary.select(F.col("template_text").alias(text), F.col("template_id"))
    return df.join(ids, text, "left").withColumn("template_id", F.coalesce("template_id", F.lit(0)))


def with_template(df: DataFrame, message: str = "message") -> DataFrame:
    """Add the generalised text of a message."""
    return spread(df).withColumn("template_text", generalize(F.col(message)))


def assign_templates(df: DataFrame, dictionary: DataFrame, message: str = "message") -> DataFrame:
    """Generalise and look up."""
    return lookup_ids(with_template(df, message), dictionary)


def template_stats(df: DataFrame) -> DataFrame:
    """Count and anomaly rate per template in one aggregation."""
    return df.groupBy("template_text").agg(
        F.count(F.lit(1)).alias("count"), F.avg("label").alias("anomaly_rate")
    )


def templates_per_source(df: DataFrame, source: str = "service", approximate: bool = False) -> DataFrame:
    """Distinct templates per source; exact by default."""
    counter = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(source).agg(counter("template_text").alias("unique_templates"))


def top_templates(stats: DataFrame, n: int = 20) -> DataFrame:
    """Most frequent templates, ties by text."""
    return top_k(stats, [F.desc("count"), F.asc("template_text")], n)


def frequency_buckets(stats: DataFrame) -> DataFrame:
    """Number of templates per frequency bucket; empty buckets are left out."""
    bucket: Column = F.lit(FREQUENCY_BUCKETS[0][0])
    for name, low in FREQUENCY_BUCKETS[1:]:
        bucket = F.when(F.col("count") >= low, name).otherwise(bucket)
    return stats.groupBy(bucket.alias("freq_bucket")).agg(F.count(F.lit(1)).alias("n_templates"))


def encode(df: DataFrame, dictionary: DataFrame, template: str = "template_id") -> DataFrame:
    """Add ``token_id``: template id plus the offset, or the unknown token."""
    known = dictionary.select(F.col("template_id").alias(template), F.lit(True).alias("_known"))
    token = F.when(F.col("_known"), F.col(template) + OFFSET).otherwise(UNK_ID)
    return df.join(known, template, "left").withColumn("token_id", token).drop("_known")


def decode(df: DataFrame, dictionary: DataFrame, token: str = "token_id") -> DataFrame:
    """Add ``template_id`` (null for reserved or unknown tokens) and ``text`` of each token."""
    texts = dictionary.select(
        (F.col("template_id") + OFFSET).alias(token), "template_id", F.col("template_text").alias("_text")
    )
    text = F.when(F.col(token) == PAD_ID, "<PAD>").otherwise(F.coalesce("_text", F.lit("<UNK>")))
    return df.join(texts, token, "left").withColumn("text", text).drop("_text")


def vocabulary(dictionary: DataFrame) -> DataFrame:
    """``token_id, text`` of the reserved tokens and of every template."""
    reserved = dictionary.sparkSession.createDataFrame(
        [(PAD_ID, "<PAD>"), (UNK_ID, "<UNK>")], "token_id int, text string"
    )
    return reserved.unionByName(
        dictionary.select((F.col("template_id") + OFFSET).cast("int").alias("token_id"),
                          F.col("template_text").alias("text"))
    )


def raw_to_token(df: DataFrame, dictionary: DataFrame, message: str = "message") -> DataFrame:
    """Raw line to token id in one plan."""
    found = assign_templates(df, dictionary, message)
    token = F.when(F.col("template_id") > 0, F.col("template_id") + OFFSET).otherwise(UNK_ID)
    return found.withColumn("token_id", token.cast("int"))


def family_key(text: Column, words: int = 4) -> Column:
    """First words of a template that are no placeholder, or ``_other``."""
    plain = F.filter(
        F.split(text, " "), lambda w: (w != "") & ~(w.startswith("<") & w.endswith(">"))
    )
    return F.when(F.size(plain) == 0, "_other").otherwise(F.concat_ws(" ", F.slice(plain, 1, words)))


def template_families(dictionary: DataFrame, chunk: int = 10_000) -> DataFrame:
    """``family, part, tokens``: token ids of the templates that share a family key.

    A family longer than ``chunk`` tokens continues in further parts.
    """
    from logspark.operators.sequences import session_chunks

    keyed = dictionary.select(
        family_key(F.col("template_text")).alias("family"), "template_id",
        (F.col("template_id") + OFFSET).alias("token_id"),
    )
    return session_chunks(keyed, ["family"], ["template_id"], "token_id", chunk)
