"""Collocations by dynamic itemset counting of phrases over cyclic scans of shards.

The corpus is dealt out to shards, which are scanned one after the other, over and over. All lengths are counted in
the same scans: words from the start, a longer phrase from the first step at which both its phrases of one word less
(without the last, without the first word) have reached the threshold. A phrase is counted for one full cycle from
the step it became active, so its count is exact; counting ends when nothing active is left.

Each step adds one table of counts, pre-aggregated per batch and per task. A phrase whose counts of the last cycle
reach the threshold has a step with its share of it, so only phrases with such a step are summed over the steps; the
many rare ones are written once and not moved again. The scan learns what has reached the threshold from two bitmaps
of fixed size, all such phrases and those of the last cycle; a false entry costs rows that the exact tables sort out.

Texts are lower-cased (A-Z only) and split into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and
tabs; phrases stay within pieces. Everything is per language, null being ``und``; null and empty texts have no words.
Repeated rows count as often as they come. A piece longer than a slice is cut with the overlap of the longest phrase.
Only ``text`` and ``lang`` are read, so further columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.words import chain
from logspark.session import materialise, workspace

THRESHOLD = 100
LONGEST = 5
SHARDS = 4
TOP = 2000
#: A bitmap has 2^CELLS_BITS cells at most (2 MB), an eighth or less of that while it has SPARE cells per entry.
CELLS_BITS = 24
SPARE = 16
#: A written table of no more phrases than this (some 30 bytes each) is sent to the counts; others meet them by shuffle.
BROADCAST_ROWS = 250_000
#: Bytes of text taken at once.
SLICE_BYTES = 2 << 20
KEY = ["lang", "phrase"]

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TO_LINES = bytes.maketrans(_BREAKS, b"\n" * len(_BREAKS))
_WORDS_ON = re.compile(rb"[ \t]+[^ \t\n]+")


def slices(texts: list[str | None], longest: int, size: int) -> Iterator[tuple[bytes, int]]:
    """Lower-cased text with line breaks between pieces, and the number of its bytes in which counted phrases start."""
    held, length = [], 0
    for text in texts:
        data = (text or "").encode().lower().translate(_TO_LINES)
        at = 0
        while len(data) - at > size:  # cut after a piece, or inside a very long one before a word
            end = data.rfind(b"\n", at, at + size)
            if end > at:
                yield data[at:end], end - at
                at = end
                continue
            spaces = max(data.rfind(b" ", at + 1, at + size), data.rfind(b"\t", at + 1, at + size))
            if spaces < 0:
                found = re.compile(rb"[ \t\n]").search(data, at + size)
                spaces = found.start() if found else len(data)
            end = spaces
            for _ in range(longest - 1):
                more = _WORDS_ON.match(data, end)
                if not more:
                    break
                end = more.end()
            yield data[at:end], spaces - at
            at = spaces
        held.append(data[at:])
        length += len(data) - at
        if length >= size:
            yield b"\n".join(held), length + len(held)
            held, length = [], 0
    if held:
        yield b"\n".join(held), length + len(held)


def words_of(data: bytes) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Words, where they start, and whether a break follows them."""
    x = np.frombuffer(data, np.uint8)
    inside = (x != 32) & (x != 9) & (x != 10)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(x[inside].tobytes())])
    lines = np.cumsum(x == 10)
    ends_piece = np.ones(len(starts), bool)
    ends_piece[:-1] = lines[starts[1:]] != lines[starts[:-1]]
    return words.dictionary_encode(), starts, ends_piece


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def seed_of(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang)


class Bitmaps:
    """Which phrases have reached the threshold, and which of them in the last cycle; false entries are possible."""

    def __init__(self, packed: dict[str, bytes]):
        self.bits = {k: np.frombuffer(v, np.uint8) for k, v in packed.items()}

    def has(self, kind: str, hashes: np.ndarray) -> np.ndarray:
        if kind not in self.bits:
            return np.zeros(len(hashes), bool)
        at = cells(hashes, len(self.bits[kind]).bit_length() + 2)
        return (self.bits[kind][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def folded(packed: np.ndarray) -> bytes:
    """A bitmap with eight cells as one, as long as that leaves ``SPARE`` cells per entry."""
    while len(packed) > 1024 and np.bitwise_count(packed).sum() * SPARE <= len(packed):
        packed = np.packbits(packed != 0, bitorder="little")
    return packed.tobytes()


def same(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns of integers below ``size`` (2^31 at most), compared exactly, and their numbers.

    Columns are packed into one integer as far as 63 bits reach; what is longer goes on from the ranks of the packed part.
    Sorting values alone is several times as fast as sorting their places with them.
    """
    bits = max(1, (size - 1).bit_length())
    fit = max(1, 63 // bits)
    packed = columns[0].astype(np.int64)
    for column in columns[1:fit]:
        packed = packed << bits | column
    if len(columns) > fit:
        head, ranks = np.unique(packed, return_inverse=True)
        (ranks, *rest), times = same([ranks, *columns[fit:]], max(size, len(head)))
        packed = head[ranks]
    else:
        packed, rest = np.sort(packed), []
        first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
        packed, times = packed[first], np.diff(np.append(first, len(packed)))
    width = min(fit, len(columns))
    return [packed >> bits * (width - 1 - i) & (1 << bits) - 1 for i in range(width)] + rest, times


def phrases_in(data: bytes, own: int, lang: str, maps: Bitmaps, words: bool, longest: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Length, phrases and counts of the active phrases of a slice."""
    encoded, starts, ends_piece = words_of(data)
    codes, names = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
    if not len(codes):
        return
    counted = starts < own
    if words:
        times = np.bincount(codes[counted], minlength=len(names))
        some = np.flatnonzero(times)
        yield 1, names.take(pa.array(some)), times[some]
    plain = np.fromiter(map(xxhash.xxh64_intdigest, names.to_pylist()), np.uint64, len(names))
    # of the phrase that starts at each of ``at``: whether it has reached the threshold, and whether lately
    at, seed = np.arange(len(codes)), seed_of(lang)
    hash_of = chain([plain], seed)
    hot, fresh = maps.has("hot", hash_of)[codes], maps.has("fresh", hash_of)[codes]
    for length in range(2, longest + 1):
        follows = at[1:] == at[:-1] + 1  # places are in order, so what starts a word later comes next
        good = hot[:-1] & hot[1:] & follows & ~ends_piece[at[:-1] + length - 2]
        at, active = at[:-1][good], (fresh[:-1] | fresh[1:])[good]
        if not len(at):
            return
        emit = at[active & counted[at]]
        if len(emit):
            distinct, times = same([codes[emit + i] for i in range(length)], len(names))
            parts = [names.take(pa.array(column)) for column in distinct]
            yield length, pc.binary_join_element_wise(*parts, pa.scalar(b" ")), times
        hashes = chain([plain[codes[at + i]] for i in range(length)], seed)
        hot, fresh = maps.has("hot", hashes), maps.has("fresh", hashes)
        at, hot, fresh = at[hot], hot[hot], fresh[hot]


def scan(shard: DataFrame, maps, words: bool, longest: int) -> DataFrame:
    """``lang, phrase, words, n``: counts of the active phrases in a shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bitmaps(maps.value)
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                texts = batch.column(1).filter(pc.equal(batch.column(0), lang)).to_pylist()
                for data, own in slices(texts, longest, SLICE_BYTES):
                    for length, phrases, times in phrases_in(data, own, lang, known, words, longest):
                        n = len(phrases)
                        yield pa.RecordBatch.from_arrays([
                            pa.array([lang] * n, pa.string()), phrases.cast(pa.string()), pa.array(np.full(n, length, np.int32)), pa.array(times.astype(np.int64)),
                        ], ["lang", "phrase", "words", "n"])

    rows = shard.select("lang", "text").mapInArrow(run, "lang string, phrase string, words int, n long")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def hashes_of(langs: list[str], phrases: list[str]) -> np.ndarray:
    """Hashes of phrases as the scan computes them."""
    words = [p.encode().split(b" ") for p in phrases]
    sizes = np.array([len(w) for w in words])
    out = np.zeros(len(words), np.uint64)
    for lang in set(langs):
        own = np.array([x == lang for x in langs])
        for size in np.unique(sizes[own]):
            at = np.flatnonzero(own & (sizes == size))
            plain = np.array([xxhash.xxh64_intdigest(w) for i in at for w in words[i]], np.uint64).reshape(-1, size)
            out[at] = chain(list(plain.T), seed_of(lang))
    return out


def bitmap(phrases: DataFrame, bits: int) -> np.ndarray | None:
    """One bit per cell of the phrases, None without any; what reaches the driver is no larger than the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = cells(hashes_of(batch.column(0).to_pylist(), batch.column(1).to_pylist()), bits)
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["cell"])

    found = phrases.select("lang", "phrase").mapInArrow(run, "cell long")
    block, bit = F.shiftright("cell", 15).alias("block"), F.bitmap_construct_agg(F.pmod("cell", F.lit(1 << 15))).alias("bits")
    rows = found.groupBy(block).agg(bit).collect()
    packed = np.zeros(1 << (bits - 3), np.uint8)
    for row in rows:
        packed[row["block"] << 12 : row["block"] + 1 << 12] = np.frombuffer(row["bits"], np.uint8)
    return packed if rows else None


def first_words(phrase: Column | str, count: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), 1, count), " ")


def last_words(phrase: Column | str, start: Column | int) -> Column:
    """The words from number ``start`` on."""
    return F.array_join(F.slice(F.split(phrase, " "), start, F.size(F.split(phrase, " "))), " ")


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def sent(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is counted as small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def often_seen(counts: DataFrame, threshold: int, shards: int) -> DataFrame:
    """Phrases with a step's share of the threshold in one table of counts, written once for the steps that ask for them."""
    return materialise(counts.where(F.col("n") >= -(-threshold // shards)).select(*KEY), "phrases-often")


def newly_hot(
    counts: list[DataFrame], often: list[DataFrame], hot: DataFrame | None, step: int, threshold: int, shards: int
) -> DataFrame:
    """``lang, phrase, words, since, hot_at``: phrases that reach the threshold with the last of ``counts``.

    ``often`` has the phrases of each of ``counts`` with a step's share; only those not hot yet are summed. Rows find them
    by hash: what else shares a hash stays below the threshold or is hot, and both are sorted out exactly.
    """
    steps = range(step - len(counts) + 1, step + 1)
    recent = union([c.withColumn("step", F.lit(u)) for u, c in zip(steps, counts, strict=True)])
    likely = union(often).distinct()
    if hot is not None:
        hot = sent(hot)
        likely = likely.join(hot.select(*KEY), KEY, "left_anti")
    mark = F.xxhash64(*KEY).alias("mark")
    likely = materialise(likely.select(mark).distinct(), "phrases-likely")
    of_step = [F.sum(F.when(F.col("step") == u, F.col("n")).otherwise(0)).alias(f"n{u}") for u in steps]
    summed = recent.select("*", mark).join(sent(likely), "mark", "left_semi").groupBy(*KEY, "words").agg(*of_step).where(sum(F.col(f"n{u}") for u in steps) >= threshold)
    since = F.lit(0)
    if hot is not None:
        summed = materialise(summed, "phrases-summed")
        summed = summed.join(hot.select(*KEY), KEY, "left_anti")
        ends = hot.select("lang", F.col("phrase").alias("part"), "hot_at")
        summed = summed.withColumn("head", F.when(F.col("words") > 1, first_words("phrase", F.col("words") - 1)))
        summed = summed.withColumn("tail", F.when(F.col("words") > 1, last_words("phrase", 2)))
        summed = summed.join(ends.withColumnsRenamed({"part": "head", "hot_at": "head_at"}), ["lang", "head"], "left")
        summed = summed.join(ends.withColumnsRenamed({"part": "tail", "hot_at": "tail_at"}), ["lang", "tail"], "left")
        summed = summed.where("words = 1 or (head_at is not null and tail_at is not null)")
        since = F.when(F.col("words") == 1, 0).otherwise(F.greatest("head_at", "tail_at"))
    summed = summed.withColumn("since", since.cast("int"))
    own = sum(F.when(F.col("since") <= u, F.col(f"n{u}")).otherwise(0) for u in steps)  # a false entry may have come before
    return summed.where((own >= threshold) & (F.col("since") + shards > step)).select(
        *KEY, "words", "since", F.lit(step + 1).alias("hot_at")
    )


def in_shards(corpus: DataFrame) -> DataFrame:
    """The corpus, written so that a scan reads its shard only."""
    path = f"{workspace(corpus.sparkSession)}/logspark/phrases-shards-{uuid.uuid4().hex}"
    corpus.write.partitionBy("shard").parquet(path)
    return corpus.sparkSession.read.schema("lang string, text string, shard int").parquet(path)


def frequent_phrases(
    docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, bits: int = CELLS_BITS
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of all phrases found ``threshold`` times or more, and ``lang, n``, words in all."""
    spark = docs.sparkSession
    number = F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")
    corpus = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    corpus = in_shards(corpus.withColumn("shard", number))
    counts: list[DataFrame] = []
    often: list[DataFrame] = []
    hot: list[DataFrame] = []
    maps: list[np.ndarray | None] = []
    step = 0
    while step < shards or any(m is not None for m in maps[-shards:]):
        known = {"hot": maps, "fresh": maps[-shards:]}
        known = {kind: reduce(np.bitwise_or, some) for kind, m in known.items() if (some := [x for x in m if x is not None])}
        shared = spark.sparkContext.broadcast({kind: folded(bits) for kind, bits in known.items()})
        found = scan(corpus.where(F.col("shard") == step % shards), shared, step < shards, longest)
        counts.append(materialise(found, "phrases-counts"))
        often = [*often, often_seen(counts[-1], threshold, shards)][-shards:]
        if len(hot) > shards:
            hot = [materialise(union(hot), "phrases-hot")]
        new = newly_hot(counts[-shards:], often, union(hot) if hot else None, step, threshold, shards)
        hot.append(materialise(new, "phrases-hot"))
        maps.append(bitmap(hot[-1].where(F.col("words") < longest), bits))
        maps[:-shards] = [reduce(np.bitwise_or, old)] if (old := [m for m in maps[:-shards] if m is not None]) else []
        shared.destroy()
        step += 1
    every = union([c.withColumn("step", F.lit(u)) for u, c in enumerate(counts)])
    known = materialise(union(hot).select(*KEY, "words", "since"), "phrases-known")
    whole = (F.col("step") >= F.col("since")) & (F.col("step") < F.col("since") + shards)
    frequent = every.select(*KEY, "n", "step").join(sent(known), KEY).where(whole).groupBy(*KEY, "words").agg(F.sum("n").alias("f"))
    totals = union(counts[:shards]).where("words = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    return materialise(frequent, "phrases-frequent"), materialise(totals, "phrases-totals")


def collocations(
    docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, top: int = TOP, inside_percent: int = 100
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of two words or more by their weakest cut.

    Phrases inside a longer one that is found ``inside_percent`` percent as often are left out. Scores are exact:
    1000 * a * n and l * r are decimals of 38 digits, enough for counts up to 10^17.
    """
    frequent, totals = frequent_phrases(docs, threshold, longest, shards)
    return ranked(frequent, totals, top, inside_percent)


def ranked(frequent: DataFrame, totals: DataFrame, top: int, inside_percent: int) -> DataFrame:
    """Scores, containment and ranks of counted phrases."""
    found = frequent.where("words > 1").withColumnRenamed("f", "a")
    # every shorter phrase of two words or more inside a longer one: a fixed number per phrase
    lengths = F.sequence(F.lit(2), F.col("words") - 1)
    spots = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda s: F.struct(s.alias("s"), m.alias("m")))))
    inner = found.where("words > 2").select("lang", "phrase", "a", F.explode(spots).alias("x"))
    inner = inner.select("lang", F.array_join(F.slice(F.split("phrase", " "), F.col("x.s"), F.col("x.m")), " ").alias("phrase"), "a")
    inner = inner.groupBy(*KEY).agg(F.max("a").alias("longer"))
    kept = found.join(inner, KEY, "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a"))).drop("longer")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"head": first_words("phrase", F.col("k")), "tail": last_words("phrase", F.col("k") + 1)})
    part = frequent.select("lang", F.col("phrase").alias("part"), "f")
    cuts = cuts.join(part.withColumnsRenamed({"part": "head", "f": "l"}), ["lang", "head"])
    cuts = cuts.join(part.withColumnsRenamed({"part": "tail", "f": "r"}), ["lang", "tail"])
    cuts = cuts.join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r", "n")}
    over, under = wide["a"] * wide["n"] * F.lit(1000).cast("decimal(38,0)"), wide["l"] * wide["r"]
    score = F.expr("x div y").cast("bigint")
    scored = cuts.withColumns({"x": over, "y": under}).withColumn("score", score)
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    best = scored.groupBy("lang", "phrase", "a", "n").agg(weakest).select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    numbered = best.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return numbered.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
