"""Near duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

* Texts with equal shingle sets are one class; only classes are compared, so exact copies cost one row each.
* A signature has 128 minima. A level reads it in several orders and sorts the classes of each order by their
  first ``depth`` minima; classes that share them are neighbours in that order, a region.
* In each region every class is first compared with the region's head, the smallest class number. That is linear
  in the region and joins groups of near copies at once. Then classes of different components are compared
  pairwise while the region is small.
* A crowded region adapts: if it still holds several components, its classes go on to the next level, with
  longer prefixes and more orders, which joins most of what belongs together at little cost.
* Crowded regions of the first level that hold several components after that are finished exactly: of two similar
  sets, each has a shared shingle among its rarest quarter, so classes of different components that share one of
  these are compared. No pair depends on the second level alone.

A pair at the threshold of 0.75 shares a region of the first level with probability 1 - (1 - 0.75^4)^32, all but
5 in a million; each minimum is read once there, so the orders are independent.

Shingles are five lower-cased words (A-Z only); a shorter text is one shingle. Null texts and texts without
words have the empty set and are linked with nothing. Shingles are compared by 64-bit hashes, classes by 128.
Null ids never name a component unless it has no other; repeated rows share their class and its decision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.words import WordHashes, chain
from logspark.session import materialise

SHINGLE = 5
PERCENT = 75
MINIMA = 128
CROWDED = 32
#: (depth, orders) of each level
LEVELS = [(4, 32), (8, 96)]
BROADCAST_ROWS = 1_000_000
#: The table of shingle counts has 2^CELLS_BITS cells, summed in blocks of BLOCK cells.
CELLS_BITS = 22
BLOCK = 1024

_RNG = np.random.Generator(np.random.PCG64(7))
_FACTORS = (_RNG.integers(1, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFTS = _RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint32)[:, None]


_WORDS = WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = (text or "").encode().lower().split()
    hashes = _WORDS.of(words)
    if len(hashes) < SHINGLE:
        return chain([hashes[i : i + 1] for i in range(len(hashes))], len(hashes) + 1) if len(hashes) else hashes
    n = len(hashes) - SHINGLE + 1
    return np.unique(chain([hashes[i : i + n] for i in range(SHINGLE)], 0))


def signature(found: np.ndarray) -> np.ndarray:
    """``MINIMA`` smallest values of linear hashes of the set."""
    low = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(low, (_FACTORS * short[None, at : at + 1024] + _SHIFTS).min(axis=1), out=low)
    return low


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, text_hash, text`` to ``doc_id, text_hash, n, set_key, minima``."""
    for batch in batches:
        sets = [shingles(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
            pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
        ], ["doc_id", "text_hash", "n", "set_key", "minima"])


def read_orders(level: int) -> np.ndarray:
    """Signature places that each order of a level reads, in reading order."""
    depth, orders = LEVELS[level]
    rng = np.random.Generator(np.random.PCG64(100 + level))
    first = np.arange(MINIMA).reshape(-1, depth)
    rounds = [first] + [rng.permutation(MINIMA).reshape(-1, depth) for _ in range(orders * depth // MINIMA)]
    return np.concatenate(rounds)[:orders]


def prefixes(classes: DataFrame, level: int) -> DataFrame:
    """``region, cid, comp, n``: one row per class and order; the region names the order and prefix."""
    places = read_orders(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                cid, comp, n, minima = batch.columns
                matrix = np.frombuffer(b"".join(minima.to_pylist()), np.uint32).reshape(-1, MINIMA).astype(np.uint64)
                parts = [np.broadcast_to(np.arange(len(places), dtype=np.uint64), (len(matrix), len(places)))]
                parts += [matrix[:, places[:, k]] for k in range(places.shape[1])]
                region = chain(parts, level).view(np.int64).reshape(-1)
                again = np.repeat(np.arange(len(matrix)), len(places))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(region), *[c.take(pa.array(again)) for c in (cid, comp, n)]], ["region", "cid", "comp", "n"]
                )

    return classes.select("cid", "comp", "n", "minima").mapInArrow(run, "region long, cid long, comp long, n long")


def sent(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is counted as small; larger ones are joined by shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def alike(a: str, b: str) -> Column:
    """Whether two set sizes allow the similarity asked for."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def set_of_classes(docs: DataFrame, classes: DataFrame, needed: DataFrame) -> DataFrame:
    """``cid, members`` (packed sorted shingle hashes) of the classes ``needed``."""
    needed = materialise(needed.join(classes.select("cid", "set_key", "rep"), "cid"), "neardup-needed")
    texts = docs.join(sent(needed), (F.col("text_hash") == F.col("rep.text_hash")) & F.col("doc_id").eqNullSafe(F.col("rep.doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, s) for c, k, t in zip(*(x.to_pylist() for x in batch.columns), strict=True)
                    if xxhash.xxh3_128_digest(s := shingles(t).tobytes()) == k]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["cid", "members"]
            )

    found = texts.select("cid", "set_key", "text").mapInArrow(run, "cid long, members binary")
    return materialise(found, "neardup-sets")


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``a, b`` whose full sets are similar enough."""
    for batch in batches:
        keep = []
        for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    if sets is None:
        sets = set_of_classes(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
    rows = pairs.select("a", "b").join(sets.select(F.col("cid").alias("a"), F.col("members").alias("left")), "a")
    rows = rows.join(sets.select(F.col("cid").alias("b"), F.col("members").alias("right")), "b")
    links = rows.select("a", "b", "left", "right").mapInArrow(confirmed, "a long, b long").distinct()
    return materialise(links, "neardup-links")


def places(found: np.ndarray, bits: int) -> np.ndarray:
    """Cells of shingle hashes in a table of 2^bits."""
    return (found >> np.uint64(64 - bits)).astype(np.int64)


def shingle_counts(sets: DataFrame, bits: int) -> np.ndarray:
    """Per cell in how many sets one of its shingles occurs, 65,535 at most: no shingle is in more sets than that.

    Tasks count into tables of fixed size and send the cells that are not empty, packed by block; blocks are summed as
    they stream by. The driver gets 2 bytes a cell.
    """
    size = min(BLOCK, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for members in batch.column(0).to_pylist():
                table[places(np.frombuffer(members, np.uint64), bits)] += 1  # a cell once per set
        for part in range(0, len(table), size * size):
            at = np.flatnonzero(table[part : part + size * size])
            blocks, first = np.unique(at // size, return_index=True)
            ends = [*first[1:], len(at)]
            cells, counts = (at % size).astype(np.uint16), table[part + at]
            packed = [[x[i:j].tobytes() for i, j in zip(first, ends, strict=True)] for x in (cells, counts)] if len(at) else [[], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks + part // size, pa.int64()), *[pa.array(x, pa.binary()) for x in packed]], ["block", "cells", "counts"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if block not in sums:
                    sums[block] = np.zeros(size, np.uint64)
                sums[block][np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint32)
        packed = [np.minimum(v, 0xFFFF).astype(np.uint16).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(packed, pa.binary())], ["block", "counts"])

    found = sets.select("members").mapInArrow(count, "block long, cells binary, counts binary")
    rows = found.repartition("block").mapInArrow(add, "block long, counts binary").collect()
    table = np.zeros(1 << bits, np.uint16)
    blocks = table.reshape(-1, size)
    for row in rows:
        blocks[row["block"]] = np.frombuffer(row["counts"], np.uint16)
    return table


def rare_shingle_pairs(sets: DataFrame, comps: DataFrame, bits: int = CELLS_BITS) -> DataFrame:
    """Pairs of different components that share one of each side's rarest shingles; every similar pair is among them.

    A set of n shingles keeps the first n - ceil(0.75 n) + 1 in one order of all shingles, that of their cells'
    counts and then of their hashes. Any such order serves; this one puts rare shingles first. What is alone in its
    cell is in no other set and pairs with nothing, so it takes its place and is not sent. From the first shingle
    that two sets share on, each must have enough left for the overlap that the threshold asks of their sizes.
    """
    counts = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets, bits))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cid", "comp", "n", "left", "shingle"]
        for batch in batches:
            held, rows = [], 0
            for cid, comp, members in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = np.frombuffer(members, np.uint64)
                n, times = len(found), counts.value[places(found, bits)]
                first = np.lexsort((found, times))[: n - -(-n * PERCENT // 100) + 1]
                at = np.flatnonzero(times[first] > 1)
                held.append([np.full(len(at), cid), np.full(len(at), comp), np.full(len(at), n), n - at, found[first[at]].view(np.int64)])
                rows += len(at)
                if rows >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
                    held, rows = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)

    rows = sets.join(comps.select("cid", "comp"), "cid").select("cid", "comp", "members")
    kept = rows.mapInArrow(rarest, "cid long, comp long, n long, left long, shingle long")
    enough = (100 + PERCENT) * F.least("a_left", "b_left") >= PERCENT * (F.col("a_n") + F.col("b_n"))
    return across(materialise(kept, "neardup-rare"), "shingle", "left", where=enough)


def across(rows: DataFrame, key: str, *more: str, where: Column | None = None) -> DataFrame:
    """Pairs ``a < b`` of classes of different components that share ``key`` and are alike in size."""
    left, right = (rows.select(key, *[F.col(c).alias(f"{s}_{c}") for c in ("cid", "comp", "n", *more)]) for s in "ab")
    joined = (F.col("a_comp") != F.col("b_comp")) & (F.col("a_cid") < F.col("b_cid")) & alike("a_n", "b_n")
    pairs = left.join(right, key).where(joined if where is None else joined & where)
    return pairs.select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``cid, root`` of all linked classes; the root is the smallest of its component.

    Alternates two steps until nothing moves: each node tells its larger neighbours of its smallest one, then
    each node's smaller neighbours meet at the smallest. Both are a minimum per node and a join.
    """
    def star(edges: DataFrame, both: bool) -> DataFrame:
        ways = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
        least = ways.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        moved = ways.join(least, "a")
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if both else moved.select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.*")
        return moved.where("a > b").distinct()

    edges, seen = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), None
    while True:
        edges = materialise(star(star(edges, True), False), "neardup-stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("cid"), F.col("b").alias("root")).unionAll(
                edges.select(F.col("b").alias("cid"), F.col("b").alias("root")).distinct()
            )
        seen = now


def with_components(classes: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links)
    kept = classes.drop("comp").join(roots, "cid", "left")
    return kept.withColumn("comp", F.coalesce("root", "cid")).drop("root")


def link_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """All confirmed links that the levels find between classes, as ``a, b``; those inside known components are skipped."""
    links, active, first = None, classes.withColumn("comp", F.col("cid")), None
    for level in range(len(LEVELS)):
        rows = prefixes(active, level)
        regions = materialise(
            rows.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.min("cid").alias("head"), F.max("cid").alias("other"))
            .where("head < other").drop("other"), "neardup-regions",
        )
        members = materialise(rows.join(sent(regions), "region"), "neardup-members")
        sizes = classes.select(F.col("cid").alias("head"), F.col("n").alias("head_n"))
        heads = members.where("cid > head").select(F.col("head"), F.col("cid"), "n").distinct().join(sizes, "head")
        if links is not None:
            roots = sent(active.select(F.col("cid").alias("head"), F.col("comp").alias("head_comp")))
            heads = heads.join(active.select("cid", "comp"), "cid").join(roots, "head").where("comp != head_comp")
        heads = materialise(heads.where(alike("n", "head_n")).select(F.col("head").alias("a"), F.col("cid").alias("b")), "neardup-heads")
        found = confirm(docs, classes, heads)
        links = found if links is None else links.unionAll(found)

        roots = materialise(components(links), "neardup-roots")
        now = members.drop("comp").join(roots, "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root")
        mixed = now.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("region")
        now = materialise(now.join(mixed, "region"), "neardup-mixed")
        pairs = across(now.where(F.col("rows") <= CROWDED), "region")
        pairs = materialise(pairs.join(heads, ["a", "b"], "left_anti"), "neardup-pairs")
        found = confirm(docs, classes, pairs)
        links = links.unionAll(found)
        crowded = now.where(F.col("rows") > CROWDED).select("region", "cid")
        first = crowded if first is None else first
        crowded = sent(materialise(crowded.select("cid").distinct(), "neardup-crowded"))
        active = materialise(with_components(classes.join(crowded, "cid"), links), "neardup-active")
        if active.isEmpty():
            break
    return finished(docs, classes, links, first)


def finished(docs: DataFrame, classes: DataFrame, links: DataFrame, regions: DataFrame) -> DataFrame:
    """``links`` and all those between classes that share one of ``regions`` (``region, cid``)."""
    roots = materialise(components(links), "neardup-roots")
    now = regions.join(roots, "cid", "left").withColumn("comp", F.coalesce("root", "cid"))
    several = now.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("region")
    left = sent(materialise(now.join(several, "region").select("cid", "comp").distinct(), "neardup-open"))
    left = materialise(classes.join(left, "cid"), "neardup-active")
    if left.isEmpty():
        return links
    sets = set_of_classes(docs, classes, left.select("cid"))
    pairs = materialise(rare_shingle_pairs(sets, left), "neardup-pairs")
    return links.unionAll(confirm(docs, classes, pairs, sets))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): ``doc_id, text_hash, n_shingles, component_id, kept``.

    ``text_hash`` and ``doc_id`` together name the row's text, for joining the decision back.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    described = materialise(docs.mapInArrow(
        describe, "doc_id long, text_hash long, n long, set_key binary, minima binary"
    ), "neardup-described")
    classes = described.where("n > 0").groupBy("set_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("rep"),
        F.max("n").alias("n"), F.max("minima").alias("minima"),
    )
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "neardup-classes")
    links = link_classes(docs, classes)
    grouped = with_components(classes.select("cid", "set_key", "rep"), links)
    names = grouped.groupBy("comp").agg(F.min("rep.doc_id").alias("component_id"))
    named = materialise(grouped.join(names, "comp").select("set_key", "component_id"), "neardup-components")
    rows = described.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "set_key")
    some = rows.where("n_shingles > 0").join(named, "set_key").drop("set_key")
    none = rows.where("n_shingles = 0").drop("set_key").withColumn("component_id", F.col("doc_id"))
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows of a component other than the one with its smallest id; repeated rows stay once."""
    found = near_duplicates(docs.select("doc_id", "text")).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")
    ).distinct()
    rows = docs.withColumn("_text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_hash"])
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi").drop("_text_hash")
