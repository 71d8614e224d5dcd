"""Next-token model: smoothed transition table, surprise, predictions.

The contract is that of a sequence model (token in, next-token probabilities out); the estimates are
smoothed transition frequencies instead of a trained network, so its numbers are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.operators.features import last_tokens
from logspark.operators.ordering import rank_within


def transition_model(counts: DataFrame, vocab: DataFrame, alpha: float = 0.1) -> DataFrame:
    """``token, next_token, cnt, prob``: ``(cnt + alpha) / (cnt(token) + alpha * |vocab|)`` of seen pairs.

    ``vocab`` has one row per token. The table grows with the vocabulary, not with the data.
    """
    size = vocab.agg(F.count(F.lit(1))).scalar()
    out = counts.groupBy("token").agg(F.sum("cnt").alias("from_cnt"))
    prob = (F.col("cnt") + F.lit(alpha)) / (F.col("from_cnt") + F.lit(alpha) * size)
    return counts.join(out, "token").select("token", "next_token", "cnt", "from_cnt", prob.alias("prob"))


def pair_surprise(pairs: DataFrame, model: DataFrame, vocab: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Add ``nll = -ln p(next_token | token)``; unseen pairs get the smoothing mass alone."""
    size = vocab.agg(F.count(F.lit(1))).scalar()
    seen = model.select("token", "next_token", "prob")
    froms = model.select("token", "from_cnt").distinct()
    unseen = F.lit(alpha) / (F.coalesce("from_cnt", F.lit(0)) + F.lit(alpha) * size)
    return (
        pairs.join(seen, ["token", "next_token"], "left")
        .join(froms, "token", "left")
        .withColumn("nll", -F.log(F.coalesce("prob", unseen)))
        .drop("prob", "from_cnt")
    )


def next_token_nll(
    sessions: DataFrame, pair_counts: DataFrame, model: DataFrame, vocab: DataFrame, alpha: float = 0.1
) -> DataFrame:
    """Mean and maximum surprise per session, 0 for a session of fewer than two events.

    ``pair_counts`` is already counted per (session, pair), so hot pairs and sessions are small here.
    """
    scored = pair_surprise(pair_counts, model, vocab, alpha).groupBy("session_id").agg(
        (F.sum(F.col("cnt") * F.col("nll")) / F.sum("cnt")).alias("mean_nll"), F.max("nll").alias("max_nll")
    )
    zero = F.lit(0.0)
    return sessions.select("session_id").join(scored, "session_id", "left").select(
        "session_id", F.coalesce("mean_nll", zero).alias("mean_nll"), F.coalesce("max_nll", zero).alias("max_nll")
    )


def validation_loss(
    train: DataFrame, val: DataFrame, vocab: DataFrame, alphas: list[float]
) -> DataFrame:
    """``alpha, loss``: mean surprise of validation pairs under the counts of training pairs, per constant.

    Both sides enter as pair counts, so one pass over vocabulary-sized tables serves every constant.
    """
    size = vocab.agg(F.count(F.lit(1))).scalar()
    froms = train.groupBy("token").agg(F.sum("cnt").alias("from_cnt"))
    seen = train.select("token", "next_token", F.col("cnt").alias("seen"))
    zero = F.lit(0)
    joined = val.join(seen, ["token", "next_token"], "left").join(froms, "token", "left")
    rows = joined.select(
        "cnt", F.coalesce("seen", zero).alias("seen"), F.coalesce("from_cnt", zero).alias("from_cnt"),
        F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"),
    )
    nll = -F.log((F.col("seen") + F.col("alpha")) / (F.col("from_cnt") + F.col("alpha") * size))
    return rows.groupBy("alpha").agg((F.sum(F.col("cnt") * nll) / F.sum("cnt")).alias("loss"))


def best_alpha(losses: DataFrame) -> Column:
    """Constant with the lowest validation loss, as a scalar."""
    return losses.agg(F.min_by("alpha", F.struct("loss", "alpha"))).scalar()


def top_predictions(df: DataFrame, order: list[str], model: DataFrame, dictionary: DataFrame, k: int = 5) -> DataFrame:
    """Most probable next templates after the last event of each session, with probability and text.

    The ranking is made once per token, over its successors, and then joined to the sessions.
    """
    best = rank_within(model, ["token"], [F.desc("prob"), F.asc("next_token")], k)
    texts = dictionary.select(F.col("template_id").alias("next_token"), F.substring("template_text", 1, 60).alias("text"))
    named = best.join(texts, "next_token", "left").select("token", "rank", "next_token", F.round("prob", 6).alias("prob"), "text")
    return last_tokens(df, order).join(named, "token")


def event_surprise(df: DataFrame, model: DataFrame, vocab: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Add ``nll`` of the step to ``next_token`` to events that carry it; the last event of a key gets null."""
    pairs = df.withColumnRenamed("template_id", "token")
    scored = pair_surprise(pairs, model, vocab, alpha)
    return scored.withColumn("nll", F.when(F.col("next_token").isNotNull(), F.col("nll"))).withColumnRenamed(
        "token", "template_id"
    )
