"""Secret scan: wide candidates, and a random forest that removes false positives.

Candidates are runs of 16 or more characters of keys and tokens that hold a digit. Each is described by its
length, its characters and the changes between their classes, how likely its character transitions are in
ordinary words, how much of it dictionary words cover, whether it stands in a path or address, and the words
around it, hashed. The forest is trained on labelled findings and scores every candidate of every text.

Findings come with a label from whoever reviewed them. Where there is no such table, ``label_by_assignment`` makes
one: a quoted value assigned to a name such as token or password is a secret, other candidates are not. The name
itself reaches the forest only as one of the hashed words. Words are counted over all texts, and the forest is
trained on all labelled findings. The dictionary holds the ``DICTIONARY_WORDS`` most frequent words that come
``MIN_COUNT`` times or more; transitions are those of its words.

Null and empty texts have no candidates. Repeated rows are scanned as often as they stand; null ids stay null.
Without findings of both labels every candidate gets the share of label 1 as its score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, log2
from zlib import crc32

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.session import materialise

TASK_ROWS = 50_000
DICTIONARY_WORDS = 50_000
MIN_WORD, MIN_COUNT = 3, 3
TREES, DEPTH, SEED = 50, 8, 11
THRESHOLD = 0.5
BEFORE, AFTER = 48, 24
NEIGHBOURS = 32

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d_]+")
ASSIGNED = r"""(?i)(?:token|secret|passw(?:or)?d|pwd|api_?key|access_?key|auth|credential)s?["']?\s*(?:=|:|=>)\s*["'`]$"""

FOUND = "doc_id long, start int, n_chars int, value string, before string, after string"


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, start, n_chars, value, before, after``; ``start`` counts code points from 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc, m.start(), m.end() - m.start(), m[0], text[max(0, m.start() - BEFORE) : m.start()], text[m.end() : m.end() + AFTER])
                for doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True) if text
                for m in CANDIDATE.finditer(text) if DIGIT.search(m[0])
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "n_chars", "value", "before", "after"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, FOUND)


class Language:
    """Words and character transitions of ordinary text."""

    def __init__(self, words: dict[str, int]):
        self.words = frozenset(words)
        pairs, singles = Counter(), Counter()
        for word, n in words.items():
            for a, b in zip(word, word[1:]):
                pairs[a + b] += n
                singles[a] += n
        self.transitions = {p: log((n + 0.5) / (singles[p[0]] + 20)) for p, n in pairs.items()}

    def likelihood(self, value: str) -> float:
        low = value.lower()
        return sum(self.transitions.get(low[i : i + 2], -8.0) for i in range(len(low) - 1)) / max(1, len(low) - 1)

    def coverage(self, value: str) -> float:
        """Share of characters in dictionary words, the longest first from the left."""
        covered = 0
        for part in WORD.findall(value.lower()):
            at = 0
            while at < len(part):
                end = next((e for e in range(min(len(part), at + 20), at + MIN_WORD - 1, -1) if part[at:e] in self.words), None)
                covered += end - at if end else 0
                at = end or at + 1
        return covered / len(value)


def learn_language(docs: DataFrame) -> Language:
    """Frequent words of all texts; what comes to the driver is the dictionary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(w for t in batch.column(0).to_pylist() for w in WORD.findall((t or "").lower()) if MIN_WORD <= len(w) <= 20)
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    return Language(most_frequent(materialise(counted, "secrets-words"), DICTIONARY_WORDS))


def most_frequent(counted: DataFrame, k: int) -> dict[str, int]:
    """The ``k`` words of highest ``n``, ties to the smaller word. No task sends rows below the lowest count kept."""
    last, room = None, k
    for row in counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("n").desc()).collect():
        last = row["n"]
        if row["words"] >= room:
            break
        room -= row["words"]
    if last is None:
        return {}
    ties = counted.where(F.col("n") == last).orderBy("word").limit(room)
    return dict([*counted.where(F.col("n") > last).collect(), *ties.collect()])


def kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def describe(value: str, before: str, after: str, language: Language) -> list[float]:
    n, kinds = len(value), [kind(c) for c in value]
    runs = [1]
    for a, b in zip(kinds, kinds[1:]):
        runs.append(runs[-1] + 1 if a == b else 1)
    counts = Counter(value)
    near = [0.0] * NEIGHBOURS
    for word in [*WORD.findall(before.lower())[-3:], *WORD.findall(after.lower())[:2]]:
        near[crc32(word.encode()) % NEIGHBOURS] = 1.0
    low = value.lower()
    return [
        float(n), *[kinds.count(k) / n for k in range(4)], len(counts) / n,
        -sum(c / n * log2(c / n) for c in counts.values()), sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1), max(runs) / n,
        float(all(c in "0123456789abcdef" for c in low)), float(n % 8 == 0),
        language.likelihood(value), language.coverage(value),
        float(value.count("/")), float("://" in before[-24:] or "www." in before[-24:]), float(before[-1:] in "/." and before != ""),
        float(before[-1:] in "\"'`" and before != ""), float("=" in before[-4:] or ":" in before[-4:]), float(after[:1] == "@"), *near,
    ]


def with_features(found: DataFrame, language: Language) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(language)
    at = [found.columns.index(c) for c in ("value", "before", "after")]
    names = [*found.columns, "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in at], strict=True)
            described = pa.array([describe(*r, shared.value) for r in rows], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, described], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return found.mapInArrow(run, f"{schema}, features array<double>")


def label_by_assignment(found: DataFrame) -> DataFrame:
    """Candidates with ``label`` by what they are assigned to."""
    return found.withColumn("label", F.col("before").rlike(ASSIGNED).cast("int"))


def fit(findings: DataFrame) -> RandomForestClassificationModel | float:
    """Forest over ``features`` and ``label`` of all labelled findings; a number if there is one label only."""
    n, ones = findings.agg(F.count("label"), F.sum("label")).first()
    if not ones or ones == n:
        return float(bool(ones))
    rows = findings.where(F.col("label").isNotNull()).select("doc_id", "start", F.col("label").cast("double").alias("label"), array_to_vector("features").alias("vector"))
    # the draws of a tree follow the place of a row, so places are fixed
    rows = rows.repartition(max(8, -(-n // TASK_ROWS)), "doc_id").sortWithinPartitions("doc_id", "start").select("label", "vector")
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="chances",
    )
    return forest.fit(rows)


def apply(described: DataFrame, forest: RandomForestClassificationModel | float) -> DataFrame:
    """Candidates with ``score`` and ``is_secret``."""
    kept = [c for c in described.columns if c != "features"]
    if isinstance(forest, float):
        scored = described.select(*kept, F.lit(forest).alias("score"))
    else:
        scored = forest.transform(described.withColumn("vector", array_to_vector("features")))
        scored = scored.select(*kept, vector_to_array("chances")[1].alias("score"))
    return scored.withColumn("is_secret", F.col("score") >= THRESHOLD)


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """All candidates of ``docs`` with ``score`` and ``is_secret``.

    ``findings`` has the columns of ``candidates`` and ``label``; by default they are labelled by assignment.
    """
    docs = docs.select("doc_id", "text")
    language = learn_language(docs)
    described = materialise(with_features(candidates(docs), language), "secrets-candidates")
    labelled = label_by_assignment(described) if findings is None else with_features(findings, language)
    return apply(described, fit(labelled))


def secret_report(docs: DataFrame) -> DataFrame:
    """``doc_id, start, n_chars, value_sha256, score, is_secret`` of each candidate; values stay in the dark."""
    return scan(docs).select("doc_id", "start", "n_chars", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")
