"""Session features in long form: scalars, entropy, token and bigram counts, fit and transform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.operators.ordering import exact_quantiles, top_k, with_position
from logspark.session import materialise


def session_steps(df: DataFrame, order: list[str], **kw) -> DataFrame:
    """``session_id, token, next_token, cnt``: how often each token is followed by each next one in a session.

    The last event of a session has a null ``next_token``. Written once: token counts, lengths, bigrams
    and vocabularies all follow from this table, whose rows per session are bounded by the vocabulary
    and not by the events, so the events are scanned and shuffled a single time.
    """
    placed = with_position(
        df.select("session_id", *order, "template_id"), ["session_id"], order, following={"next_token": "template_id"}, **kw
    )
    steps = placed.groupBy("session_id", F.col("template_id").alias("token"), "next_token").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    return materialise(steps, "steps")


def token_counts(df: DataFrame) -> DataFrame:
    """``session_id, token, cnt`` of events or of session steps; the base of the count features."""
    if "next_token" in df.columns:
        return df.groupBy("session_id", "token").agg(F.sum("cnt").alias("cnt"))
    return df.groupBy("session_id", F.col("template_id").alias("token")).agg(F.count(F.lit(1)).alias("cnt"))


def session_scalars(counts: DataFrame) -> DataFrame:
    """Length, distinct tokens and their ratio."""
    per = counts.groupBy("session_id").agg(
        F.sum("cnt").alias("sequence_length"), F.count(F.lit(1)).alias("unique_count")
    )
    return per.withColumn("unique_ratio", F.col("unique_count") / F.col("sequence_length"))


def entropy_term(p: Column, *, runtime: bool = False) -> Column:
    """``-p log2 p`` with p clipped at 1e-12, or with 1e-12 added inside the logarithm."""
    inner = p + F.lit(1e-12) if runtime else F.greatest(p, F.lit(1e-12))
    return -p * F.log2(inner)


def session_entropy(counts: DataFrame, *, runtime: bool = False) -> DataFrame:
    """Shannon entropy of the token distribution of each session.

    Lengths come from a grouped join, not a window, so no session has to fit one task.
    """
    lengths = counts.groupBy("session_id").agg(F.sum("cnt").alias("_n"))
    p = F.col("cnt") / F.col("_n")
    return counts.join(lengths, "session_id").groupBy("session_id").agg(
        F.sum(entropy_term(p, runtime=runtime)).alias("template_entropy")
    )


def topk_vocab(counts: DataFrame, k: int = 100) -> DataFrame:
    """Most frequent tokens of a count table, ties by token."""
    total = counts.groupBy("token").agg(F.sum("cnt").alias("cnt"))
    return top_k(total, [F.desc("cnt"), F.asc("token")], k)


def bigram_name(a: Column, b: Column, joiner: str = ">") -> Column:
    """``a>b``."""
    return F.concat(a.cast("string"), F.lit(joiner), b.cast("string"))


def bigram_counts(steps: DataFrame) -> DataFrame:
    """``session_id, token, next_token, cnt`` of neighbours in a session."""
    return steps.where(F.col("next_token").isNotNull())


def transition_counts(steps: DataFrame) -> DataFrame:
    """``token, next_token, cnt`` over all sessions."""
    return bigram_counts(steps).groupBy("token", "next_token").agg(F.sum("cnt").alias("cnt"))


def top_bigrams(steps: DataFrame, m: int = 100) -> DataFrame:
    """Most frequent pairs over all sessions, ties by tokens."""
    return top_k(transition_counts(steps), [F.desc("cnt"), F.asc("token"), F.asc("next_token")], m)


class FeatureModel:
    """Vocabulary of features fitted on the steps of one set of sessions and applied to any other.

    The vocabulary is a small written table of at most ``k + m`` rows; ``transform`` keeps the long
    form ``session_id, feature, value`` and ``wide`` pivots it over the explicit feature list.
    """

    def __init__(self, vocabulary: DataFrame):
        self.vocabulary = vocabulary

    @classmethod
    def fit(cls, steps: DataFrame, k: int = 100, m: int = 100) -> FeatureModel:
        """Top ``k`` tokens and top ``m`` bigrams; a token row has no ``next_token``."""
        tokens = topk_vocab(steps, k).select("token", F.lit(None).cast("int").alias("next_token"))
        bigrams = top_bigrams(steps, m).select("token", F.col("next_token").cast("int").alias("next_token"))
        return cls(materialise(tokens.unionByName(bigrams).coalesce(1), "features"))

    def transform(self, steps: DataFrame) -> DataFrame:
        """Long features: scalars and entropy for all sessions, nonzero counts and shares of the vocabulary.

        Steps are brought together by session once; all counts, lengths and joins on the session use
        that partitioning.
        """
        together = steps.repartition("session_id")
        lengths = together.groupBy("session_id").agg(F.sum("cnt").alias("n"))
        tokens = token_counts(together).join(lengths, "session_id")
        pairs = bigram_counts(together).join(lengths, "session_id")
        known_tokens = self.vocabulary.where(F.col("next_token").isNull()).select("token")
        known_pairs = self.vocabulary.where(F.col("next_token").isNotNull())
        summary = tokens.groupBy("session_id").agg(
            F.max("n").alias("n"), F.count(F.lit(1)).alias("u"), F.sum(entropy_term(F.col("cnt") / F.col("n"))).alias("h")
        )
        value = lambda name, c: F.struct(F.lit(name).alias("feature"), c.cast("double").alias("value"))
        scalars = F.array(
            value("sequence_length", F.col("n")), value("unique_template_count", F.col("u")),
            value("unique_ratio", F.col("u") / F.col("n")), value("template_entropy", F.col("h")),
        )
        token_name = F.concat(F.lit("tid_"), F.col("token").cast("string"))
        pair_name = F.concat(F.lit("bgram_"), bigram_name(F.col("token"), F.col("next_token"), "_to_"))
        return (
            summary.select("session_id", F.inline(scalars))
            .unionByName(
                tokens.join(known_tokens, "token", "left_semi")
                .select("session_id", F.inline(_count_and_share(token_name, F.col("n"))))
            )
            .unionByName(
                pairs.join(known_pairs, ["token", "next_token"], "left_semi")
                .select("session_id", F.inline(_count_and_share(pair_name, F.greatest(F.col("n") - 1, F.lit(1)))))
            )
        )

    def columns(self) -> list[str]:
        """Names of the vocabulary features: at most ``2 (k + m)``, the width of the pivot."""
        rows = sorted(self.vocabulary.collect(), key=lambda r: (r.next_token is not None, r.token, r.next_token or 0))
        names = [f"tid_{r.token}" if r.next_token is None else f"bgram_{r.token}_to_{r.next_token}" for r in rows]
        return [c for n in names for c in (n, f"{n}_norm")]

    def wide(self, long: DataFrame) -> DataFrame:
        """One row per session, one column per feature, 0 where absent."""
        base = ["sequence_length", "unique_template_count", "unique_ratio", "template_entropy"]
        names = base + self.columns()
        return long.groupBy("session_id").pivot("feature", names).agg(F.first("value")).na.fill(0.0)


def _count_and_share(name: Column, length: Column) -> Column:
    return F.array(
        F.struct(name.alias("feature"), F.col("cnt").cast("double").alias("value")),
        F.struct(F.concat(name, F.lit("_norm")).alias("feature"), (F.col("cnt") / length).alias("value")),
    )


def feature_totals(long: DataFrame) -> DataFrame:
    """Sum of each count feature over all sessions, largest first when ordered by ``total``."""
    is_count = F.col("feature").rlike("^(tid|bgram)_") & ~F.col("feature").endswith("_norm")
    return long.where(is_count).groupBy("feature").agg(F.sum("value").alias("total"))


def session_summary(sessions: DataFrame, counts: DataFrame) -> DataFrame:
    """Number, mean, median and maximum length of sessions, and vocabulary size, in one row."""
    lengths = sessions.select(F.col("sequence_length").cast("double").alias("sequence_length"))
    median = exact_quantiles(lengths, "sequence_length", {"median_length": 0.5})
    n_vocab = counts.select("token").distinct().agg(F.count(F.lit(1)).alias("n"))
    return sessions.agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.avg("sequence_length").alias("mean_length"),
        F.max("sequence_length").alias("max_length"),
    ).withColumns({"median_length": median.scalar(), "vocabulary": n_vocab.scalar()})


def longest_sessions(sessions: DataFrame, n: int = 10) -> DataFrame:
    """Longest sessions, ties by id."""
    return top_k(sessions, [F.desc("sequence_length"), F.asc("session_id")], n)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value of a column."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(column).alias("field"), "value", "n"
    )


def last_tokens(df: DataFrame, order: list[str]) -> DataFrame:
    """Last token of each session, by partial aggregation."""
    return df.groupBy("session_id").agg(F.max_by("template_id", F.struct(*order)).alias("token"))
