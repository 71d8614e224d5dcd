"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its words, word pairs and pairs with one or two words between (letters only, lower case),
hashed to 2^20 places. The learner keeps two sums per place; learning rates fall per coordinate, and places whose
gradients stay within the L1 bound have weight zero, so a model is a short list of places.

Training reads a bounded sample of labelled rows, chosen by a hash of the text: about ``TRAIN_ROWS``. Shards
learn by themselves for a pass, then their sums are averaged and the next pass starts from them. Scoring reads
every text whole against the broadcast weights. Only the text is an input; labels come from training rows alone.

Null and empty texts have the bias only. Rows without a label or an id are scored, not learned. Of repeated
labels each distinct one counts. Without labelled rows all scores are 0.5. Ids that are not there count as held out never.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.llm.words import WordHashes, chain
from logspark.session import materialise

PLACES_BITS = 20
BIAS = 1 << PLACES_BITS
GAPS = (1, 2, 3)
START = 5
TRAIN_ROWS = 40_000
SHARDS = 4
PASSES = 4
#: Places whose gradient over the sample, before anything is learned, is below so many L1 bounds or so many of its own
#: standard deviations stay out of training.
SCREEN, DEVIATIONS = 1.5, 2.0
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.0
#: What a toxic example counts for, as they are few and often hold a single word that shows it.
TOXIC_WEIGHT = 4.0
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1

_LETTERS = regex.compile(r"\p{L}+")
_WORDS = WordHashes()


def places(text: str | None) -> np.ndarray:
    """Hashed features of a text, with repeats."""
    found = _LETTERS.findall((text or "").lower())
    words = _WORDS.of(found)
    starts = _WORDS.of([w[:START] for w in found if len(w) > START])
    grams = [chain([words], 0), chain([starts], 0)]
    grams += [chain([words[:-gap], words[gap:]], gap) for gap in GAPS if len(words) > gap]
    return (np.concatenate(grams) >> np.uint64(64 - PLACES_BITS)).astype(np.int32)


class Ftrl:
    """FTRL-proximal sums ``z`` and ``n`` per place; the bias is not subject to the L1 bound."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros(BIAS + 1) if z is None else z
        self.n = np.zeros(BIAS + 1) if n is None else n

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, bound = self.z[at], np.where(at == BIAS, 0.0, L1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - bound, 0.0)
        return -shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (TOXIC_WEIGHT if label else 1.0)
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + gradient * gradient


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``key, label, places``: a sample of about ``rows`` labelled texts, by a hash of the id."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.select("doc_id", F.col("toxic").cast("int").alias("label")).distinct()
    share = min(1.0, rows / max(1, marked.count()))
    key = F.xxhash64("doc_id")
    marked = marked.withColumn("key", key).where(F.pmod("key", F.lit(1 << 30)) < int(share * (1 << 30)))
    # about ``rows`` rows by the share above, a documented bound
    found = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("key", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.unique(places(t)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(at, pa.binary())], ["key", "label", "places"])

    return screened_places(materialise(found.mapInArrow(run, "key long, label int, places binary"), "toxicity-texts"))


def screened_places(train: DataFrame) -> DataFrame:
    """``train`` without the places that the L1 bound holds at zero from the start or that look like chance."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, BIAS), dtype=np.int32)
        for batch in batches:
            for label, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[label, np.frombuffer(packed, np.int32)] += 1
        at = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[0, at]), pa.array(totals[1, at])], ["at", "n0", "n1"])

    toxic, rows = train.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("label")).first()
    base = TOXIC_WEIGHT * toxic / max(1.0, TOXIC_WEIGHT * toxic + rows - toxic)
    share = toxic / max(1, rows)
    variance = share * (TOXIC_WEIGHT * (1 - base)) ** 2 + (1 - share) * base**2
    # the sample is bounded, and each task makes a row for every place
    counts = train.select("label", "places").coalesce(SHARDS).mapInArrow(count, "at int, n0 int, n1 int").groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    gradient = F.abs(F.col("n0") * base - F.col("n1") * (TOXIC_WEIGHT * (1 - base)))
    often = np.zeros(BIAS, dtype=bool)
    noise = F.sqrt((F.col("n0") + F.col("n1")) * variance)
    often[counts.where((gradient >= SCREEN * L1) & (gradient >= DEVIATIONS * noise)).select("at").toArrow()["at"].to_numpy()] = True
    shared = train.sparkSession.sparkContext.broadcast(np.packbits(often))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            found = [np.frombuffer(p, np.int32) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([f[known[f]].tobytes() for f in found], pa.binary())], ["key", "label", "places"])

    return materialise(train.mapInArrow(keep, "key long, label int, places binary"), "toxicity-train")


def one_pass(state) -> Callable[[pa.Table], pa.Table]:
    """A pass of one shard from the broadcast sums; returns what it adds to them."""
    def run(table: pa.Table) -> pa.Table:
        z, n = state.value
        own = Ftrl(z.copy(), n.copy())
        for label, packed in zip(table["label"].to_pylist(), table["places"].to_pylist(), strict=True):
            own.learn(np.append(np.frombuffer(packed, np.int32), BIAS), label)
        at = np.flatnonzero((own.z != z) | (own.n != n)).astype(np.int32)
        return pa.table({"at": at, "z": own.z[at] - z[at], "n": own.n[at] - n[at]})

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the model; both are short."""
    train, spark = training_rows(docs, labels, rows), docs.sparkSession
    model = Ftrl()
    for _ in range(PASSES):
        state = spark.sparkContext.broadcast((model.z, model.n))

        shard = F.pmod(F.shiftright("key", 31), F.lit(SHARDS)).alias("shard")  # a shard has a bounded number of rows
        ordered = train.withColumn("shard", shard).repartition(SHARDS, "shard").sortWithinPartitions("shard", "key", "label", "places")
        moved = ordered.groupBy("shard").applyInArrow(one_pass(state), "at int, z double, n double")
        # one row per place and no more, whatever the corpus holds
        total = moved.groupBy("at").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()
        at = total["at"].to_numpy()
        z, n = model.z.copy(), model.n.copy()
        z[at] += total["z"].to_numpy() / SHARDS
        n[at] += total["n"].to_numpy() / SHARDS
        model = Ftrl(z, n)
        state.unpersist()
    weights = model.weights(np.arange(BIAS + 1))
    at = np.flatnonzero(weights).astype(np.int32)
    return at, weights[at]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` with ``score`` between 0 and 1 and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text, names = docs.columns.index("text"), [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BIAS + 1)
        table[shared.value[0]] = shared.value[1]
        for batch in batches:
            sums = []
            for text in batch.column(at_text).to_pylist():
                at = places(text)
                sums.append(table[BIAS] + table[np.unique(at[table[at] != 0])].sum())
            scores = 1 / (1 + np.exp(-np.clip(np.array(sums, dtype=float), -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names)

    scored = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` without those predicted toxic."""
    names = {c: f"_own_{c}" for c in ("score", "predicted") if c in docs.columns}
    kept = score(docs.withColumnsRenamed(names), model).where("predicted = 0").drop("score", "predicted")
    return kept.withColumnsRenamed({own: c for c, own in names.items()})
