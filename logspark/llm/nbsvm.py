"""Text quality by naive Bayes support vectors: n-gram indicators scaled by log-count ratios, then a hinge-loss model.

A text is the set of its words and word pairs (lower case) and of its runs of one to four word shapes, hashed to
2^20 places. A shape keeps the kinds of characters of a word in order (upper, lower, digit, or the sign itself,
repeats once) and whether the word repeats the one before it. From the training rows each place gets the log ratio
of its smoothed share among good and bad texts; a text's vector has these ratios at its places and length one.
A linear model with hinge loss is fitted to the vectors by dual coordinate descent. Shards of rows descend by
themselves from the common weights for a round, then their changes are averaged (dual variables likewise). Scores
are margins through a logistic curve fitted to the training rows.

Training reads a bounded sample of labelled rows, by a hash of the id: about ``TRAIN_ROWS``. Places found in fewer
than ``MIN_TEXTS`` of them are not learned. Every text is scored whole. Only the text is an input of a score.

Null and empty texts have no places and get the score of the bias alone. Rows without a label or an id are scored,
not learned; of several texts under one labelled id the smallest is learned; of repeated labels each distinct one
counts. Without labelled rows, or with one class only, every score is that class's smoothed share. Ids that are not
there count as not held out. Further columns pass through ``score``; columns named ``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.llm.words import chain
from logspark.session import materialise

PLACES_BITS = 20
PLACES = 1 << PLACES_BITS
BIAS = PLACES
TRAIN_ROWS = 20_000
MIN_TEXTS = 3
SMOOTHING = 1.0
SHARDS, ROUNDS, EPOCHS = 8, 5, 2
ROUND_TASKS = 4
COST = 10.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
KNOWN_WORDS, KNOWN_LENGTH = 100_000, 64


class Model(NamedTuple):
    """Places in ascending order, their ratios and weights, the bias, and the slope and offset of the score."""

    at: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float


def shape(word: str) -> str:
    """Kinds of characters in order, each run once: ``U`` upper, ``l`` other letters, ``0`` digits, else the sign."""
    kinds = ["U" if c.isupper() else "l" if c.isalpha() else "0" if c.isdigit() else c for c in word]
    return "".join(k for k, before in zip(kinds, ["", *kinds]) if k != before)


class Words(dict):
    """Hashes of a word and of its shape, kept for short words up to a fixed number."""

    def __missing__(self, word: str) -> tuple[int, int]:
        own = xxhash.xxh64_intdigest(word.lower())
        pair = own, xxhash.xxh64_intdigest(shape(word), seed=1)
        if len(word) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = pair
        return pair


def places(text: str | None, known: Words) -> np.ndarray:
    """Distinct hashed features of a text, ascending."""
    found = (text or "").split()
    pairs = np.array([known[w] for w in found], dtype=np.uint64).reshape(-1, 2)
    words, shapes = pairs[:, 0], pairs[:, 1].copy()
    shapes[1:] ^= (words[1:] == words[:-1]).astype(np.uint64)  # the word before once more
    grams = [chain([words], 10), *[chain([words[:-1], words[1:]], 11) for _ in range(len(words) > 1)]]
    for n in range(1, 5):
        if len(shapes) >= n:
            grams.append(chain([shapes[i : len(shapes) - n + 1 + i] for i in range(n)], 20 + n))
    return np.unique((np.concatenate(grams) >> np.uint64(64 - PLACES_BITS)).astype(np.int32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``key, shard, label, places`` of a sample of about ``rows`` labelled texts outside the held-out fold."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    share = min(1.0, rows / max(1, marked.count()))
    marked = marked.withColumn("key", F.xxhash64("doc_id")).where(F.pmod("key", F.lit(1 << 30)) < int(share * (1 << 30)))
    # about ``rows`` rows by the share above, a documented bound
    found = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    found = found.groupBy("key", "label").agg(F.min("text").alias("text"))
    shard = F.pmod(F.shiftright("key", 31), F.lit(SHARDS)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            packed = [places(t, known).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], ["key", "shard", "label", "places"])

    rows_in = found.select("key", shard.alias("shard"), "label", "text")
    return materialise(rows_in.mapInArrow(run, "key long, shard int, label int, places binary"), "quality-train")


def log_ratios(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places found often enough and the log ratio of their shares among good and bad texts; at most ``PLACES``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, PLACES), dtype=np.int64)
        for batch in batches:
            for label, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[label, np.frombuffer(packed, np.int32)] += 1
        at = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[0, at]), pa.array(totals[1, at])], ["at", "bad", "good"])

    # the sample is bounded, and each task makes one row per place
    counts = train.select("label", "places").coalesce(SHARDS).mapInArrow(count, "at int, bad long, good long")
    counts = counts.groupBy("at").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    table = counts.where(F.col("bad") + F.col("good") >= MIN_TEXTS).toArrow().sort_by("at")
    bad, good = (table[c].to_numpy().astype(float) + SMOOTHING for c in ("bad", "good"))
    return table["at"].to_numpy().astype(np.int32), np.log(good / good.sum()) - np.log(bad / bad.sum())


def vector(where: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the model and values of a text's vector of length one."""
    values = ratio[where]
    size = np.sqrt(values @ values)
    return where, values / size if size else values


def descend(rows: list, labels: np.ndarray, weights: np.ndarray, alpha: np.ndarray, cost: np.ndarray, seed: int) -> None:
    """Dual coordinate descent over the rows for some epochs, in place; the last weight is the bias."""
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            where, values = rows[i]
            side = 1.0 if labels[i] else -1.0
            gradient = side * (weights[where] @ values + weights[-1]) - 1.0
            new = min(max(alpha[i] - gradient / (values @ values + 1.0), 0.0), cost[labels[i]])
            step, alpha[i] = (new - alpha[i]) * side, new
            if step:
                weights[where] += step * values
                weights[-1] += step


def packed_shards(train: DataFrame, at: np.ndarray) -> DataFrame:
    """``shard, labels, sizes, found``: the rows of a shard in a fixed order, as positions of the model's places.

    One row per shard, ``TRAIN_ROWS / SHARDS`` texts of the bounded sample, so that rounds move nothing but weights.
    """
    shared = train.sparkSession.sparkContext.broadcast(at)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("label", "ascending"), ("places", "ascending")])
        found = [np.frombuffer(p, np.int32) for p in table["places"].to_pylist()]
        number = np.full(PLACES, -1, np.int32)
        number[shared.value] = np.arange(len(shared.value))
        found = [n[n >= 0] for f in found for n in [number[f]]]
        arrays = [table["label"].to_numpy().astype(np.int32), np.array([len(f) for f in found], np.int32), np.concatenate(found)]
        return pa.table({"shard": table["shard"][:1], **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("labels", "sizes", "found"), arrays, strict=True)}})

    shards = train.repartition(SHARDS, "shard").groupBy("shard").applyInArrow(pack, "shard int, labels binary, sizes binary, found binary")
    return materialise(shards, "quality-shards")


def one_round(ratio, state, number: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A round of each shard from the broadcast weights; gives what it changes and its margins of before.

    What the shards of a task change in the weights is one row without a shard. The last round is for the margins alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, (weights, alphas, cost), moved = ratio.value, state.value, None

        def packed(shard: int | None, *arrays: np.ndarray | None) -> pa.RecordBatch:
            found = [pa.array([None if x is None else x.tobytes()], pa.binary()) for x in arrays]
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *found], ["shard", "w", "a", "m", "y"])

        for batch in batches:
            for row in batch.to_pylist():
                labels, sizes, found = (np.frombuffer(row[c], np.int32) for c in ("labels", "sizes", "found"))
                rows = [vector(f, ratios) for f in np.split(found, np.cumsum(sizes)[:-1])]
                margins = np.array([weights[w] @ v + weights[-1] for w, v in rows])
                if number == ROUNDS:
                    yield packed(row["shard"], None, None, margins, labels)
                    continue
                own, alpha = weights.copy(), alphas.get(row["shard"], np.zeros(len(rows))).copy()
                before = alpha.copy()
                descend(rows, labels, own, alpha, cost, number)
                moved = own - weights if moved is None else moved + (own - weights)
                yield packed(row["shard"], None, alpha - before, None, None)
        if moved is not None:
            yield packed(None, moved, None, None, None)

    return run


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(good | margin) by Newton steps, targets drawn in as for a uniform prior."""
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margins, np.ones(len(margins))])
    b = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + 1e-6 * np.eye(2), x @ (p - target))
        b = b - np.clip(step, -2, 2)
    return float(b[0]), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model; what comes to the driver are places, weights and dual variables of the bounded sample."""
    train, spark = training_rows(docs, labels, rows), docs.sparkSession
    n = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}  # two rows
    nothing = np.zeros(0)
    if len(n) < 2:
        share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
        return Model(nothing.astype(np.int32), nothing, nothing, 0.0, 1.0, float(np.log(share / (1 - share))))
    at, ratio = log_ratios(train)
    # the rarer class counts for as much as the other one
    cost = np.array([COST * max(1.0, n[1] / n[0]), COST * max(1.0, n[0] / n[1])])
    weights, alphas, packed = np.zeros(len(at) + 1), {}, packed_shards(train, at)
    ratios = spark.sparkContext.broadcast(ratio)
    for number in range(ROUNDS + 1):
        state = spark.sparkContext.broadcast((weights, alphas, cost))
        # each task sends one vector of weights to the driver, whatever its shards
        found = packed.coalesce(ROUND_TASKS).mapInArrow(one_round(ratios, state, number), "shard int, w binary, a binary, m binary, y binary").toArrow()
        shards = found.drop_columns("w").filter(pc.is_valid(found["shard"])).sort_by("shard").to_pylist()
        if number < ROUNDS:
            for moved in found["w"].drop_null():
                weights = weights + np.frombuffer(moved.as_buffer()) / len(shards)
            alphas = {r["shard"]: alphas.get(r["shard"], 0.0) + np.frombuffer(r["a"]) / len(shards) for r in shards}
        del found
        state.destroy()
    ratios.destroy()
    margins, marks = (np.concatenate([np.frombuffer(r[c], d) for r in shards]) for c, d in (("m", float), ("y", np.int32)))
    return Model(at, ratio, weights[:-1], float(weights[-1]), *logistic(margins, marks))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` between 0 and 1 and ``predicted``."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text, names = docs.columns.index("text"), [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, known = shared.value, Words()
        # one place holds ratio and weight of a feature, so that a text costs two look-ups
        ratio, weight = np.zeros(PLACES), np.zeros(PLACES)
        ratio[use.at], weight[use.at] = use.ratio, use.weight
        for batch in batches:
            margins = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(at_text).to_pylist()):
                found = places(text, known)
                values = ratio[found]
                size = np.sqrt(values @ values)
                margins[i] = (weight[found] @ values / size if size else 0.0) + use.bias
            scores = 1 / (1 + np.exp(-np.clip(use.slope * margins + use.offset, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names)

    scored = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
