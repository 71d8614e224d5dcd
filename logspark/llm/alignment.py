"""Alignment of two tokenizers by their bytes: which tokens overlap, where both end, and how often ids are linked.

Two tokenizers encode the same bytes, a space and the text. In batches of bounded size, keyed by document, an
as-of merge finds for each token start the token of the other side that covers it; both directions together give
each overlapping pair once (pairs with one start come from the first direction only). Bytes where tokens of both
sides end cut the document into groups.

Texts are cut before single spaces between other characters. No token of either side reaches over such a place
(for the second vocabulary this is checked), so parts are encoded alone, frequent ones are looked up, and a very
long text is worked on in slices.

Counts of id pairs are summed per chunk of documents before they are shuffled; a chunk's pairs, not those of each
document, are joined with the totals, and come back to the chunk's documents in one group of bounded size.

Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros, and empty
groups. Rows are worked on one by one: repeated rows, ties and null ids each give their own row. Further columns
pass through ``align_documents``, but for columns named like its results, which are replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.session import materialise

MAX_VOCABULARY_BYTES = 64 << 20
#: Bytes of text merged at once, and those that share one table of pairs.
SLICE_BYTES = 1 << 20
CHUNK_BYTES = 8 << 20
#: Parts up to this length are looked up; two generations of so many bytes of ids and text are kept.
KEPT_LENGTH = 64
KEPT_BYTES = 32 << 20

_CUT = re.compile(r"(?<=\S)(?= \S)")


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible bytes are themselves, the rest follow 255 in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Pair:
    """Both tokenizers with the bytes of their ids and the encodings of frequent parts."""

    def __init__(self, first: bytes, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(first.decode()), SentencePieceProcessor(model_proto=second)
        self.a.encode_special_tokens = True
        chars, vocabulary = byte_of_char(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.sizes = [np.array([len(t) for t in table]) for table in (self.bytes_a, self.bytes_b)]
        self.width = len(self.bytes_b)
        texts = [np.array([str(i) for i in range(len(t))], dtype=object) for t in (self.bytes_a, self.bytes_b)]
        #: decimal ids followed by what stands after them: inside a side, and at its end in the group
        self.spelled = [(t + ",", t + end) for t, end in zip(texts, "|;", strict=True)]
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.kept = 0

    def parts(self, text: str) -> list[str]:
        """Parts of a space and the text; each starts with a space."""
        return _CUT.split(" " + text) if self.cuts else [" " + text]

    def encode(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Packed ids of both sides for each part; None where they do not give back its bytes."""
        data = [p.encode() for p in parts]
        joined, sizes = b"".join(data), np.fromiter(map(len, data), np.int64, len(data))
        first = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        second = self.b.encode([p[1:] for p in parts], num_threads=1)
        right, packed = np.ones(len(parts), bool), []
        for k, (found, table) in enumerate(((first, self.bytes_a), (second, self.bytes_b))):
            flat = list(chain.from_iterable(found))
            ids = np.array(flat, np.int32)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            total = np.concatenate([[0], np.cumsum(self.sizes[k][ids])])[ends]
            right &= np.diff(total, prepend=0) == sizes
            if b"".join(map(table.__getitem__, flat)) != joined:
                right &= np.array([b"".join(map(table.__getitem__, x)) == d for x, d in zip(found, data, strict=True)])
            whole, bounds = ids.tobytes(), [0, *(ends * 4).tolist()]
            packed.append([whole[low:high] for low, high in pairwise(bounds)])
        return [pair if good else None for pair, good in zip(zip(*packed, strict=True), right.tolist(), strict=True)]

    def learn(self, wanted: set[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Encodings of the parts, from the kept ones as far as they go."""
        young, old = self.young, self.old
        new = [p for p in wanted if p not in young and p not in old]
        known = dict(zip(new, self.encode(new), strict=True)) if new else {}
        for part in wanted.difference(new):
            hit = young.get(part, 0)
            known[part] = old[part] if hit == 0 else hit
        for part, hit in known.items():
            if len(part) <= KEPT_LENGTH and part not in young:
                young[part] = hit
                self.kept += 200 + 2 * len(part)
        if self.kept > KEPT_BYTES:
            self.old, self.young, self.kept = young, {}, 0
        return known


class Result:
    """What is known of one document."""

    def __init__(self, keep: bool):
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.digest, self.spelled = hashlib.sha256(), [] if keep else None
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def clear(self) -> None:
        self.__init__(self.spelled is not None)

    def add_groups(self, text: str) -> None:
        text = text[:-1] if not self.n_a else ";" + text[:-1]
        self.digest.update(text.encode())
        if self.spelled is not None:
            self.spelled.append(text)


def merge(pair: Pair, work: list[tuple[Result, list[tuple[bytes, bytes]]]]) -> None:
    """Align one slice of documents, given as packed ids of both sides per part."""
    sides = []
    for k in (0, 1):
        packed = [b"".join([p[k] for p in parts]) for _, parts in work]
        ids = np.frombuffer(b"".join(packed), np.int32)
        doc = np.repeat(np.arange(len(work)), [len(p) // 4 for p in packed])
        ends = np.cumsum(pair.sizes[k][ids])
        sides.append((ids, doc, ends, ends - pair.sizes[k][ids]))
    (ids_a, doc_a, end_a, start_a), (ids_b, doc_b, end_b, start_b) = sides
    a = pd.DataFrame({"at": start_a, "doc": doc_a, "a": np.arange(len(ids_a))})
    b = pd.DataFrame({"at": start_b, "doc": doc_b, "b": np.arange(len(ids_b))})
    over = pd.merge_asof(a, b, on="at", by="doc")["b"].to_numpy()
    back = pd.merge_asof(b, a, on="at", by="doc")["a"].to_numpy()
    only = start_a[back] != start_b
    link_a = np.concatenate([np.arange(len(ids_a)), back[only]])
    link_b = np.concatenate([over, np.flatnonzero(only)])
    both_a, both_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)

    # tokens of both sides in the order of their groups
    last_b = np.flatnonzero(both_b) + 1
    last_a = np.flatnonzero(both_a) + 1
    group_a, group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
    spelled = np.empty(len(ids_a) + len(ids_b), dtype=object)
    spelled[np.arange(len(ids_a)) + np.concatenate([[0], last_b])[group_a]] = np.where(both_a, pair.spelled[0][1][ids_a], pair.spelled[0][0][ids_a])
    spelled[np.arange(len(ids_b)) + last_a[group_b]] = np.where(both_b, pair.spelled[1][1][ids_b], pair.spelled[1][0][ids_b])

    n = len(work)
    n_a, n_b, groups = np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n), np.bincount(doc_a[both_a], minlength=n)
    codes = ids_a[link_a].astype(np.int64) * pair.width + ids_b[link_b]
    order = np.lexsort((codes, doc_a[link_a]))
    codes, doc = codes[order], doc_a[link_a][order]
    first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])]))
    times = np.diff(np.append(first, len(codes)))
    codes, per_doc = codes[first], np.searchsorted(doc[first], np.arange(n + 1))
    links = np.bincount(doc, minlength=n)
    ends = np.cumsum(n_a + n_b)
    for i, (result, _) in enumerate(work):
        result.add_groups("".join(spelled[ends[i] - n_a[i] - n_b[i] : ends[i]].tolist()))
        result.n_a += int(n_a[i])
        result.n_b += int(n_b[i])
        result.n_groups += int(groups[i])
        result.n_links += int(links[i])
        result.links.append((codes[per_doc[i] : per_doc[i + 1]], times[per_doc[i] : per_doc[i + 1]]))


def align_texts(pair: Pair, texts: list[str | None], keep: bool = False) -> list[Result]:
    """Results of texts, merged slice by slice."""
    results, work, size = [], [], 0
    bad: set[int] = set()

    def flush() -> None:
        nonlocal work, size
        known, ready = pair.learn(set().union(*[parts for _, parts in work])), []
        for i, parts in work:
            hits = [known[p] for p in parts]
            if None in hits:
                bad.add(i)
            elif i not in bad:
                ready.append((results[i], hits))
        if ready:
            merge(pair, ready)
        work, size = [], 0

    for i, text in enumerate(texts):
        results.append(Result(keep))
        parts = pair.parts(text) if text else []
        if size + len(text or "") <= SLICE_BYTES:
            work.append((i, parts))
            size += len(text or "")
            continue
        low = 0
        while low < len(parts):
            high = low
            while high < len(parts) and (size < SLICE_BYTES or high == low):
                size += len(parts[high])
                high += 1
            work.append((i, parts[low:high]))
            low = high
            if size >= SLICE_BYTES:
                flush()
    if work:
        flush()
    for i in bad:
        results[i].clear()
    return results


def vocabularies(spark: SparkSession, *paths: str):
    """Contents of vocabulary files of bounded size, broadcast."""
    contents = []
    for path in paths:
        with open(path, "rb") as file:
            contents.append(file.read(MAX_VOCABULARY_BYTES + 1))
        if len(contents[-1]) > MAX_VOCABULARY_BYTES:
            raise ValueError("vocabulary too large to broadcast")
    return spark.sparkContext.broadcast(contents)


_PAIR: dict[str, Pair] = {}


def pair_of(contents: list[bytes]) -> Pair:
    """The one pair of a Python worker; another pair takes its place."""
    name = hashlib.sha256(json.dumps([hashlib.sha256(c).hexdigest() for c in contents]).encode()).hexdigest()
    if name not in _PAIR:
        _PAIR.clear()
        _PAIR[name] = Pair(*contents)
    return _PAIR[name]


def align_documents(docs: DataFrame, first_path: str, second_path: str) -> DataFrame:
    """``docs`` with ``n_a, n_b, n_groups, n_links`` and ``groups`` (``a1,a2|b1;a3|b2,b3``, ids in order)."""
    added = ["n_a", "n_b", "n_groups", "n_links", "groups"]
    docs = docs.drop(*added)
    shared, at = vocabularies(docs.sparkSession, first_path, second_path), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(shared.value)
        for whole in batches:
            for batch in chunks(whole, at):
                found = align_texts(pair, batch.column(at).to_pylist(), keep=True)
                counts = [pa.array([getattr(r, c) for r in found], pa.int64()) for c in added[:4]]
                groups = pa.array(["".join(r.spelled) for r in found], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, *counts, groups], names)

    names = [*docs.columns, *added]
    fields = [T.StructField(c, T.LongType()) for c in added[:4]] + [T.StructField("groups", T.StringType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def chunks(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``CHUNK_BYTES`` of text; a longer text is one by itself."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    number = sizes // CHUNK_BYTES
    low = 0
    while low < batch.num_rows:
        high = int(np.searchsorted(number, number[low], side="right"))
        yield batch.slice(low, high - low)
        low = high


PAIRED = (
    "doc_id {}, chunk long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, "
    "times array<int>, codes array<long>, totals array<long>"
)


def pair_table(docs: DataFrame, first_path: str, second_path: str) -> DataFrame:
    """Rows of two kinds, told apart by ``codes``: documents with places in their chunk's table of pairs and how often
    they hold them, and that table."""
    shared = vocabularies(docs.sparkSession, first_path, second_path)
    kind = docs.schema["doc_id"].dataType
    schema = T._parse_datatype_string(PAIRED.format(kind.simpleString()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = pair_of(shared.value), TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in chunks(whole, 1):
                number += 1
                found = align_texts(pair, batch.column(1).to_pylist())
                rows = len(found)
                links = [x for r in found for x in r.links]
                flat = np.concatenate([x[0] for x in links]) if links else np.zeros(0, np.int64)
                times = np.concatenate([x[1] for x in links]) if links else np.zeros(0, np.int64)
                codes, place = np.unique(flat, return_inverse=True)
                totals = np.bincount(place, weights=times, minlength=len(codes)).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum([sum(len(x[0]) for x in r.links) for r in found])]).astype(np.int32)
                none = lambda data, dtype: pa.ListArray.from_arrays(offsets, pa.array(data.astype(dtype)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(np.full(rows, number)),
                    *[pa.array([getattr(r, c) for r in found], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                    pa.array([r.digest.hexdigest() if r.n_a else "" for r in found]),
                    none(place, np.int32), none(times, np.int32),
                    *[pa.nulls(rows, pa.list_(pa.int64()))] * 2,
                ], names)
                table = [pa.array([x], pa.list_(pa.int64())) for x in (codes, totals)]
                empty = [pa.nulls(1, batch.column(0).type), pa.array([number]), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string())]
                yield pa.RecordBatch.from_arrays([*empty, *[pa.nulls(1, pa.list_(pa.int32()))] * 2, *table], names)

    names = schema.fieldNames()
    return materialise(docs.select("doc_id", "text").mapInArrow(run, schema), "alignment-pairs")


def link_report(docs: DataFrame, first_path: str, second_path: str) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    rows = pair_table(docs, first_path, second_path)
    own = rows.where(F.col("codes").isNotNull()).select("chunk", F.posexplode(F.arrays_zip("codes", "totals")).alias("place", "x"))
    own = own.select("chunk", "place", F.col("x.codes").alias("code"), F.col("x.totals").alias("n"))
    totals = materialise(own.groupBy("code").agg(F.sum("n").alias("total")), "alignment-totals")
    second = F.pmod("code", F.lit(width_of(second_path))).alias("second")
    best = totals.groupBy(second).agg(F.max("total").alias("best"))
    judged = totals.withColumn("second", second).join(best, "second").select("code", "total", (F.col("total") == F.col("best")).alias("is_best"))
    known = own.select(F.col("chunk").alias("pairs_of"), "place", "code").join(judged, "code").select("pairs_of", "place", "total", "is_best")

    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    found = rows.where(F.col("codes").isNull()).select("chunk", *columns, "places", "times")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right["place"].to_numpy()
        total, is_best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        total[at], is_best[at] = right["total"].to_numpy(), right["is_best"].to_numpy()
        places, times = (left[c].combine_chunks() for c in ("places", "times"))
        at, times = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy())])
        sums = []
        for values in (is_best, total):
            running = np.concatenate([[0], np.cumsum(values[at] * times)])
            sums.append(pa.array(running[ends[1:]] - running[ends[:-1]]))
        return left.select(columns).append_column("n_best", sums[0]).append_column("count_sum", sums[1])

    schema = T.StructType([found.schema[c] for c in columns] + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")])
    summed = found.groupBy("chunk").cogroup(known.groupBy("pairs_of")).applyInArrow(add, schema)
    return summed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def width_of(path: str) -> int:
    """Number of ids of the second vocabulary."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).get_piece_size()
