"""Mixing sources to target weights: token blocks, drawn slots and index permutations, joined by index.

The words of a source, document after document, are cut into blocks of fixed length (the last one is short).
The mix is a row of slots. A source gets as many as its target needs: whole passes over its blocks and a part
of one more, whose last block is cut so that the target is met to the word. A pseudorandom permutation of all
slots deals them out to the output shards; the source counts of a shard are thereby multinomial draws under
the condition that the totals meet the targets (free draws would exceed the cap on repeats). The n-th slot of
a source takes the block that a permutation of the source and pass maps n to; blocks then join by index.

Permutations are swap-or-not shuffles of any range [0, n): in each round x and key - x change places if a hash
bit of the pair says so. All is column expressions, joins and windows; the windows run over hash buckets of a
source and over one row per bucket or source, so a hot source is not gathered in a task. Documents with null
or blank text take no part (taken 0); a null source is a source of its own, the last; null ids are ordinary
ids; repeated rows hold their own words each. Equal weights, seed and rows give equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.words import split_words
from logspark.session import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BLOCK_WORDS = 512
SHARD_SLOTS = 1024
ROUNDS = 24
BUCKET_DIGITS = 3
CHUNK = 1 << 12
SEED = "mix-1"

ROW_KEY = ["sid", "start"]


def digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def number(hexadecimal: Column) -> Column:
    return F.conv(F.substring(hexadecimal, 1, 12), 16, 10).cast("bigint")


def round_keys(n: Column, *tags: Column, rounds: int = ROUNDS) -> Column:
    """One key in [0, n) per round; null for an empty range."""
    steps = F.sequence(F.lit(0), F.lit(rounds - 1))
    return F.when(n > 0, F.transform(steps, lambda r: F.pmod(number(digest(*tags, F.lit("key"), r)), n)))


def permute(x: Column, n: Column, keys: Column, *tags: Column) -> Column:
    """Image of ``x`` under the swap-or-not shuffle of [0, n) that ``keys`` and ``tags`` name."""
    rounds = F.transform(keys, lambda k, r: F.struct(k.alias("k"), r.alias("r")))

    def swap(at: Column, step: Column) -> Column:
        other = F.pmod(step["k"] - at, n)
        bit = F.substring(digest(*tags, step["r"], F.greatest(at, other)), 1, 1) < "8"
        return F.when(bit, other).otherwise(at)

    return F.aggregate(rounds, x.cast("bigint"), swap)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, sid, source_size, weight, target``, one row per source of ``source, source_size``.

    ``share`` of all words is dealt out by weight; what exceeds ``cap`` times a source's size is dealt out
    again among the rest until none is above. That ends where one common rate times the weight serves all
    sources below their cap, so the rate is read off the sources sorted by cap per weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.withColumn("sid", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.get(cycle, F.col("sid") % len(weights))
    )
    limit = F.col("source_size") * F.lit(cap)
    up = Window.orderBy((limit / F.col("weight")).asc(), "sid")
    earlier = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    pool = F.sum("source_size").over(everything) * F.lit(share)
    rate = (pool - F.coalesce(F.sum(limit).over(earlier), F.lit(0.0))) / F.sum("weight").over(rest)
    open_rate = F.when(rate * F.col("weight") <= limit, rate)  # sources from here on stay below their cap
    ranked = named.withColumn("_rate", open_rate)
    common = F.first("_rate", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn(
        "target", F.least(limit, F.coalesce(common, F.lit(float("inf"))) * F.col("weight"))
    ).drop("_rate")


def place(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``docs`` with ``size`` (words), ``sid``, ``source_size``, ``target`` and ``start``, its first word in the source.

    Documents of a source follow each other by hash bucket and id.
    """
    columns = docs.columns
    rows = docs.withColumns({
        "size": F.size(split_words(F.col("text"))).cast("bigint"),
        "_bucket": F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, BUCKET_DIGITS),
    })
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    buckets = materialise(buckets, "mix-buckets")
    goal = materialise(targets(buckets.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, cap), "mix-targets")
    along = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_words").over(along), F.lit(0)).alias("_before")
    )
    goal = goal.withColumnRenamed("source", "_g")
    offsets = materialise(
        offsets.join(goal, F.col("_s").eqNullSafe(F.col("_g"))).drop("_g"), "mix-offsets"
    )
    order = [F.col("doc_id"), F.col("size"), F.xxhash64("text")]
    inside = Window.partitionBy("source", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = rows.withColumn("_inner", inner).join(
        offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))
    )
    return placed.select(
        *columns, "size", "sid", "source_size", "target", (F.col("_before") + F.col("_inner")).alias("start")
    )


def slots(sources: DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: str = SEED) -> DataFrame:
    """One row per slot of the mix: ``output_shard, slot, sid, pass, block, words``.

    ``sources`` has one row per source: ``sid, source_size, target``.
    """
    size, length = F.col("source_size"), F.lit(block)
    wanted = F.least(F.round("target").cast("bigint"), size * F.lit(int(CAP)))
    plan = sources.where(size > 0).withColumns({"full": F.floor(size / length), "tail": size % length, "wanted": wanted})
    plan = plan.withColumns({
        "per_pass": F.col("full") + F.when(F.col("tail") > 0, 1).otherwise(0),
        "passes": F.floor(F.col("wanted") / size),
        "need": F.col("wanted") % size,
    })
    in_full = F.col("need") <= F.col("full") * length
    more = F.when(in_full, F.ceil(F.col("need") / length)).otherwise(F.col("full") + 1)
    last = F.col("need") - F.when(in_full, (more - 1) * length).otherwise(F.col("full") * length)
    plan = plan.withColumns({"n_slots": F.col("passes") * F.col("per_pass") + more, "last_words": last})
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumns({
        "first": F.coalesce(F.sum("n_slots").over(before), F.lit(0)),
        "all_slots": F.sum("n_slots").over(Window.partitionBy()),
    })
    plan = materialise(plan.where(F.col("n_slots") > 0).withColumns({
        "deal_keys": round_keys(F.col("all_slots"), F.lit(seed), F.lit("deal")),
        "pass_keys": F.transform(
            F.sequence(F.lit(0), F.lit(int(CAP))), lambda p: round_keys(F.col("full"), F.lit(seed), F.col("sid"), p)
        ),
    }), "mix-sources")
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_slots") - 1) / CHUNK))).alias("_chunk")
    # a number of its own, as the few rows of this exchange say nothing about the work that follows
    cores = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = plan.select("*", chunk).repartition(cores, "sid", "_chunk")
    ends = F.least(F.col("n_slots"), (F.col("_chunk") + 1) * CHUNK) - 1
    n = chunks.select("*", F.explode(F.sequence(F.col("_chunk") * CHUNK, ends)).alias("n")).withColumns({
        "pass": F.floor(F.col("n") / F.col("per_pass")).cast("int"), "_at": F.col("n") % F.col("per_pass"),
    })
    keys = F.get("pass_keys", F.col("pass"))
    taken = F.when(F.col("_at") < F.col("full"), permute(
        F.col("_at"), F.col("full"), keys, F.lit(seed), F.col("sid"), F.col("pass")
    )).otherwise(F.col("full"))
    is_last = (F.col("n") == F.col("n_slots") - 1) & (F.col("need") > 0)
    words = F.when(is_last, F.col("last_words")).when(F.col("_at") < F.col("full"), length).otherwise(F.col("tail"))
    dealt = permute(F.col("first") + F.col("n"), F.col("all_slots"), F.col("deal_keys"), F.lit(seed), F.lit("deal"))
    drawn = n.select(
        "sid", "pass", taken.alias("block"), words.cast("bigint").alias("words"), dealt.alias("_dealt")
    ).select(
        F.floor(F.col("_dealt") / shard_slots).alias("output_shard"), (F.col("_dealt") % shard_slots).alias("slot"),
        "sid", "pass", "block", "words",
    )
    return materialise(drawn, "mix-slots")  # its size is then known to the joins


def takes(placed: DataFrame, block: int = BLOCK_WORDS, **options) -> DataFrame:
    """What the mix takes of documents: ``sid, start, pass, output_shard, slot, from, words``, joined by block index.

    ``placed`` comes from ``place``; ``from`` is the place of the first word taken in its document.
    """
    sources = placed.groupBy("sid").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    drawn = slots(sources, block, **options)
    parts = placed.where(F.col("size") > 0).select(
        *ROW_KEY, "size",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"),
    )
    low = F.greatest("start", F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    return parts.join(drawn, ["sid", "block"]).where(high > low).select(
        *ROW_KEY, "pass", "output_shard", "slot", (low - F.col("start")).alias("from"), (high - low).alias("words")
    )


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken`` and ``first_shard``, the lowest output shard it is in."""
    narrow = docs.select("doc_id", "text", "source")
    placed = materialise(place(narrow).drop("text"), "mix-placed")
    each = ["doc_id", "size", "source_size", "target"]
    summed = takes(placed, **options).groupBy(*ROW_KEY).agg(
        F.sum("words").alias("taken"), F.min("output_shard").alias("first_shard")
    )
    some = placed.where(F.col("size") > 0).join(summed, ROW_KEY, "left")
    none = placed.where(F.col("size") == 0).withColumns({"taken": F.lit(0), "first_shard": F.lit(None)})
    end = [F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.col("first_shard").cast("bigint").alias("first_shard")]
    return some.select(*each, *end).unionAll(none.select(*each, *end))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: one row per document and pass that takes any of it.

    A text that a pass takes whole stays as it is; of others the words taken remain, joined by single spaces,
    and ``n_chars`` follows.
    """
    columns = docs.columns
    held = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    placed = materialise(place(held.select("_row", "doc_id", "text", "source")).drop("text"), "mix-placed")
    taken = takes(placed, **options).groupBy(*ROW_KEY, "pass").agg(
        F.sort_array(F.collect_list(F.struct("from", "words"))).alias("_ranges"), F.sum("words").alias("_taken")
    )
    # texts are moved once, to what is taken of them; their places are found without them
    parts = placed.where(F.col("size") > 0).select("_row", *ROW_KEY, F.col("size").alias("_size")).join(taken, ROW_KEY)
    rows = held.join(parts.select("_row", "_size", "_ranges", "_taken"), "_row")
    words = split_words(F.col("text"))
    pieces = F.transform("_ranges", lambda r: F.array_join(F.slice("_words", r["from"].cast("int") + 1, r["words"].cast("int")), " "))
    rows = rows.withColumn("_words", F.when(F.col("_taken") < F.col("_size"), words))
    text = F.when(F.col("_taken") == F.col("_size"), F.col("text")).otherwise(F.array_join(pieces, " "))
    out = rows.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(*columns)
