"""Operational metrics over event time: increases, rates, latency buckets, alert rules, health, retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.operators.ordering import join_null_safe, top_k
from logspark.session import materialise, spread

INDEX_ROWS = 2_000_000
# Upper bounds of the latency histogram, in seconds.
LATENCY_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]


def step_counts(df: DataFrame, time: str, keys: list[str], step: int, sums: dict[str, Column]) -> DataFrame:
    """``sums`` per key and step of ``step`` seconds; ``step_start`` is an epoch second."""
    start = (F.floor(F.col(time) / step) * step).cast("bigint").alias("step_start")
    return df.groupBy(*keys, start).agg(*[F.sum(e).alias(n) for n, e in sums.items()])


def spine(steps: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Every step of every key between the first and the last step of the whole table."""
    ends = steps.agg(F.struct(F.min("step_start").alias("lo"), F.max("step_start").alias("hi"))).scalar()
    every = F.sequence(ends.getField("lo"), ends.getField("hi"), F.lit(step).cast("bigint"))
    return steps.select(*keys).distinct().select(*keys, F.explode(every).alias("step_start"))


def increase(
    df: DataFrame, time: str, keys: list[str], sums: dict[str, Column], window: int, step: int
) -> DataFrame:
    """Increase of each counter over the trailing ``window`` seconds at every step; 0 when nothing happened.

    Rows are summed per step before any shuffle; only these sums are copied to the windows they fall in.
    """
    steps = step_counts(df, time, keys, step, sums)
    last = F.col("step_start") + F.lit(window - step)
    windows = F.sequence(F.col("step_start"), last.cast("bigint"), F.lit(step).cast("bigint"))
    spread = steps.select(*keys, F.explode(windows).alias("step_start"), *sums)
    totals = spread.groupBy(*keys, "step_start").agg(*[F.sum(n).alias(n) for n in sums])
    filled = join_null_safe(spine(steps, keys, step), totals, [*keys, "step_start"], "left")
    return filled.select(
        *keys, "step_start", *[F.coalesce(n, F.lit(0)).alias(n) for n in sums]
    )


def latency_histogram(df: DataFrame, seconds: Column, keys: list[str] = (), bounds: list[float] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative count per upper bound ``le`` (infinity last), in one aggregation."""
    counted = df.select(*keys, seconds.alias("_s")).groupBy(*keys).agg(
        *[F.count_if(F.col("_s") <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count("_s").alias(f"_b{len(bounds)}"),
    )
    rows = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cumulative"))
        for i, b in enumerate([*bounds, float("inf")])
    ]
    return counted.select(*keys, F.inline(F.array(*rows)))


def bucket_quantile(buckets: DataFrame, q: float, keys: list[str] = ()) -> DataFrame:
    """Quantile of a cumulative histogram, linear inside the bucket; above the last bound, that bound.

    Works on the few bucket rows of a key.
    """
    along = Window.partitionBy(*keys).orderBy("le")
    ranked = buckets.select(
        *keys, "le", "cumulative",
        F.coalesce(F.lag("le").over(along), F.lit(0.0)).alias("_low"),
        F.coalesce(F.lag("cumulative").over(along), F.lit(0)).alias("_below"),
        (F.max("cumulative").over(Window.partitionBy(*keys)) * F.lit(q)).alias("_rank"),
    )
    inside = F.col("_low") + (F.col("le") - F.col("_low")) * (F.col("_rank") - F.col("_below")) / (
        F.col("cumulative") - F.col("_below")
    )
    value = F.when(F.col("le") == float("inf"), F.col("_low")).otherwise(inside)
    hit = (F.col("cumulative") >= F.col("_rank")) & (F.col("_below") < F.col("_rank"))
    return ranked.where(hit).groupBy(*keys).agg(F.min_by(value, "le").alias("quantile"))


def sustained(
    steps: DataFrame, keys: list[str], condition: Column, hold: int, step: int
) -> DataFrame:
    """Periods in which ``condition`` holds at consecutive steps for at least ``hold`` seconds.

    ``steps`` has one row per key and step, so a key is as long as its time range, not its data.
    """
    along = Window.partitionBy(*keys).orderBy("step_start")
    place = F.row_number().over(along)
    true = steps.where(condition).withColumn("_island", F.col("step_start") - place * step)
    return (
        true.groupBy(*keys, "_island")
        .agg(F.min("step_start").alias("since"), F.max("step_start").alias("until"), F.count(F.lit(1)).alias("n_steps"))
        .where(F.col("until") - F.col("since") >= hold)
        .drop("_island")
    )


def stalled(df: DataFrame, time: str, keys: list[str], limit: int, step: int) -> DataFrame:
    """Gaps of at least ``limit`` seconds without a row, per key; ``step`` may not exceed ``limit``.

    The time from the last row of a key to the last row of all keys is a gap too: a stream that stopped.

    Only the first and last time of each step enter the window, so a key is as long as its time range.
    """
    if step > limit:
        raise ValueError("step must not exceed limit")
    start = F.floor(F.col(time) / step)
    edges = df.groupBy(*keys, start.alias("_step")).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    along = Window.partitionBy(*keys).orderBy("_step")
    gap = edges.select(*keys, F.lag("last").over(along).alias("stalled_from"), F.col("first").alias("stalled_to"))
    ends = edges.groupBy(*keys).agg(F.max("last").alias("stalled_from"))
    gap = gap.unionByName(ends.withColumn("stalled_to", edges.agg(F.max("last")).scalar()))
    return gap.withColumn("gap_seconds", F.col("stalled_to") - F.col("stalled_from")).where(F.col("gap_seconds") >= limit)


def health_rollup(df: DataFrame, keys: list[str], critical: list[str], optional: list[str]) -> DataFrame:
    """Worst component wins: a failed critical one is unhealthy, a failed optional one degraded.

    Component columns hold booleans. The gauge is 1, 0.5 or 0; the groups are reduced by partial aggregation.
    """
    ok_critical = F.bool_and(_all(critical))
    ok_optional = F.bool_and(_all(optional))
    status = F.when(~ok_critical, "unhealthy").when(~ok_optional, "degraded").otherwise("healthy")
    return df.groupBy(*keys).agg(status.alias("status")).withColumn(
        "gauge", F.when(F.col("status") == "healthy", 1.0).when(F.col("status") == "degraded", 0.5).otherwise(0.0)
    )


def _all(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c)
    return out


def word_index(base: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """``doc_id, part``: every part of every white-space-separated word of the knowledge base.

    A word is contained in a text exactly when it is part of one of the text's words, so containment
    turns into an equality join.
    """
    words = base.select(doc_id, F.explode(F.array_distinct(F.split(F.lower(text), r"\s+"))).alias("_w")).where("_w <> ''")
    spelled = words.select("_w").distinct()
    starts = spelled.select("_w", F.explode(F.sequence(F.lit(1), F.length("_w"))).alias("_from"))
    parts = starts.select(
        "_w", F.explode(F.transform(
            F.sequence(F.lit(1), F.length("_w") - F.col("_from") + 1),
            lambda n: F.substring(F.col("_w"), F.col("_from"), n),
        )).alias("part"),
    ).distinct()
    return words.join(parts, "_w").select(doc_id, "part").distinct()


def keyword_topk(
    questions: DataFrame, question_id: str, question: str, base: DataFrame, doc_id: str, text: Column, k: int = 3
) -> DataFrame:
    """Top ``k`` documents of the knowledge base per question by number of question words they contain.

    Ties go to the document that comes first by id; documents without a hit fill up the ranking.
    The index is written. Up to ``INDEX_ROWS`` rows it is sent to the questions, which are answered where they are,
    without a row per question and document; a larger one, or questions without ids of their own, join by shuffle.
    """
    index = materialise(word_index(base, doc_id, text), "index")
    rows, ids = questions.agg(F.count(F.lit(1)), F.count_distinct(question_id)).first()
    if rows == ids and index.count() <= INDEX_ROWS:
        return _answered_in_place(questions, question_id, question, base, doc_id, index, k)
    words = questions.select(
        question_id, F.explode(F.array_distinct(F.split(F.lower(F.col(question)), r"\s+"))).alias("part")
    ).where("part <> ''")
    hits = words.join(index, "part").groupBy(question_id, doc_id).agg(
        F.count(F.lit(1)).alias("score")
    )
    order = Window.partitionBy(question_id).orderBy(F.desc("score"), F.asc(doc_id))  # at most one row per document
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    fill = top_k(base.select(doc_id), [F.asc(doc_id)], 2 * k)  # enough unscored documents for any question
    have = ranked.groupBy(question_id).agg(F.count(F.lit(1)).alias("_have"), F.collect_set(doc_id).alias("_docs"))
    rest = questions.select(question_id).join(have, question_id, "left").where(F.coalesce("_have", F.lit(0)) < k)
    head = fill.agg(F.sort_array(F.collect_list(doc_id)).alias("a")).scalar()
    free = F.when(F.col("_docs").isNull(), head).otherwise(F.array_except(head, F.col("_docs")))
    filled = rest.select(
        question_id, F.coalesce("_have", F.lit(0)).alias("_have"),
        F.posexplode(F.slice(free, F.lit(1), F.lit(k) - F.coalesce("_have", F.lit(0)))).alias("_at", doc_id),
    ).select(question_id, doc_id, F.lit(0).cast("bigint").alias("score"),
             (F.col("_have") + F.col("_at") + 1).cast("int").alias("rank"))
    return ranked.select(question_id, doc_id, "score", F.col("rank").cast("int").alias("rank")).unionByName(filled)


def _answered_in_place(
    questions: DataFrame, question_id: str, question: str, base: DataFrame, doc_id: str, index: DataFrame, k: int
) -> DataFrame:
    """``keyword_topk`` with the postings of the index in every task."""
    table = index.select(doc_id, "part").toArrow().combine_chunks()
    docs, parts = (pc.unique(table[c]) for c in (doc_id, "part"))
    docs = docs.take(pc.sort_indices(docs))
    at = pc.index_in(table["part"], parts).to_numpy()
    owner = pc.index_in(table[doc_id], docs).to_numpy()[np.argsort(at, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(parts)))]).astype(np.int64)
    head = [r[0] for r in top_k(base.select(doc_id), [F.asc(doc_id)], 2 * k).collect() if r[0] is not None]
    shared = questions.sparkSession.sparkContext.broadcast((docs.to_pylist(), parts, first, owner, sorted(head)))

    def best(words: np.ndarray, first: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = first[words + 1] - first[words]
        ends = np.cumsum(sizes)
        at = np.repeat(first[words] - (ends - sizes), sizes) + np.arange(sizes.sum())
        scores = np.bincount(owner[at], minlength=n)
        hit = np.flatnonzero(scores)
        order = hit - scores[hit] * n
        some = np.argpartition(order, k)[:k] if len(hit) > k else np.arange(len(hit))
        hit = hit[some[np.argsort(order[some])]]
        return hit, scores[hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, first, owner, head = shared.value
        for batch in batches:
            lists = batch.column(1)
            known = pc.fill_null(pc.index_in(lists.flatten(), parts), -1).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            rows, found, score, rank = [], [], [], []
            for i, words in enumerate(np.split(known, np.cumsum(sizes)[:-1])):
                hit, n_words = best(words[words >= 0], first, owner, len(names))
                have = [names[x] for x in hit]
                free = [d for d in dict.fromkeys(head) if d not in have] if have else head
                fill = free[: k - len(have)]
                rows += [i] * (len(have) + len(fill))
                found += have + fill
                score += n_words.tolist() + [0] * len(fill)
                rank += range(1, len(have) + len(fill) + 1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, docs.type), pa.array(score, pa.int64()), pa.array(rank, pa.int32()),
            ], [question_id, doc_id, "score", "rank"])

    words = F.filter(F.array_distinct(F.split(F.lower(F.col(question)), r"\s+")), lambda w: w != "").alias("words")
    kinds = f"`{question_id}` {questions.schema[question_id].dataType.simpleString()}, `{doc_id}` {base.schema[doc_id].dataType.simpleString()}"
    return spread(questions).select(question_id, words).mapInArrow(run, f"{kinds}, score long, rank int")


def first_answer(question: Column, answers: list[tuple[str, Column]], default: Column) -> Column:
    """Answer of the first keyword the question contains."""
    text = F.lower(question)
    chain = F
    for keyword, answer in answers:
        chain = chain.when(F.contains(text, F.lit(keyword)), answer)
    return chain.otherwise(default)
