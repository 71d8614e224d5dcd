"""Exact order-dependent primitives that keep every task bounded.

A window over one key puts the whole key in one task. Where the busiest key is larger than
``target_rows`` the rows are cut into slices along the leading order column: row numbers restart in
each slice, and a small per-slice table supplies the rows that came before. Results are the same for
every slice width; only the sizes of the tasks change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.session import materialise, small_table

TARGET_ROWS = 2_000_000
BLOCK_ROWS = 2048
VALUE_BUCKETS = 1 << 20


def slice_width(df: DataFrame, keys: list[str], at: str, target_rows: int = TARGET_ROWS) -> float | None:
    """Width of ``at`` that bounds each (key, slice) by ``target_rows``; None when no key exceeds it.

    Costs one column-pruned, map-side-combined scan and returns a single row; the width shrinks while
    bursts still overfill a slice. Rows that share one value of ``at`` cannot be parted.
    """
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    top = per_key.agg(F.max("n"), F.min("lo").cast("double"), F.max("hi").cast("double")).first()
    rows, lo, hi = top
    if rows is None or rows <= target_rows or lo is None or hi <= lo:
        return None
    floor = (hi - lo) / 2**40
    width = (hi - lo) * target_rows / rows
    while width > floor:
        fullest = (
            df.groupBy(*keys, F.floor(F.col(at) / F.lit(width))).count().agg(F.max("count")).first()[0]
        )
        if fullest <= target_rows:
            return width
        width *= min(0.5, target_rows / fullest)
    return floor


def with_position(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    following: dict[str, str] | None = None,
    sizes: bool = False,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add ``pos``, the 0-based place of each row in its key, over the unique order ``order``.

    ``following`` maps a new column to the column whose value in the next row it takes; ``sizes`` adds
    ``key_rows``. The keys and ``order[0]`` must not be null, and ``order[0]`` must be numeric.
    An empty key list numbers the whole frame.
    """
    following = following or {}
    width = slice_width(df, keys, order[0], target_rows)
    if width is None:
        ordered = Window.partitionBy(*keys).orderBy(*order)
        out = df.withColumn("pos", (F.row_number().over(ordered) - 1).cast("bigint"))
        for name, source in following.items():
            out = out.withColumn(name, F.lead(source).over(ordered))
        if sizes:
            out = out.withColumn("key_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        return out

    rows = df.withColumn("_slice", F.floor(F.col(order[0]) / F.lit(width)))
    first_by = F.struct(*order)
    heads = rows.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.min_by(source, first_by).alias(f"_head_{name}") for name, source in following.items()],
    )
    along = Window.partitionBy(*keys).orderBy("_slice")
    before = F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1))
    offsets = heads.select(
        *keys,
        "_slice",
        "_n",
        F.coalesce(before, F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("key_rows"),
        *[F.lead(f"_head_{name}").over(along).alias(f"_next_{name}") for name in following],
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    out = rows.join(offsets, [*keys, "_slice"]).withColumn("_rn", F.row_number().over(inside))
    for name, source in following.items():
        out = out.withColumn(
            name,
            F.when(F.col("_rn") == F.col("_n"), F.col(f"_next_{name}")).otherwise(F.lead(source).over(inside)),
        )
    out = out.withColumn("pos", F.col("_before") + F.col("_rn") - 1)
    extra = ["key_rows"] if sizes else []
    return out.select(*df.columns, "pos", *following, *extra)


def count_windows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[str],
    window: int,
    stride: int,
    *,
    keep_short: bool = False,
    target_rows: int = TARGET_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Windows of ``window`` consecutive rows starting every ``stride`` rows of each key.

    Returns the keys, ``start`` and ``rows`` (array of structs of ``pos`` and ``values``). A trailing
    part shorter than the window is dropped; ``keep_short`` keeps the single short window of a key
    with fewer rows than that. A frame that already has ``pos`` is used as it is. Rows are packed in blocks of bounded length plus an overlap of
    ``window - 1`` rows, so neither a task nor an array grows with a key.
    """
    block = -(-max(block_rows, window) // stride) * stride
    if "pos" in df.columns:
        placed = df
    else:
        narrow = df.select(*dict.fromkeys([*keys, *order, *values]))
        placed = with_position(narrow, keys, order, target_rows=target_rows)
    own = F.floor(F.col("pos") / block)
    homes = F.when((own > 0) & (F.col("pos") % block < window - 1), F.array(own, own - 1)).otherwise(F.array(own))
    packed = (
        placed.select(*keys, "pos", *values, F.explode(homes).alias("_block"))
        .groupBy(*keys, "_block")
        .agg(F.sort_array(F.collect_list(F.struct("pos", *values))).alias("_rows"))
    )
    first = F.col("_block") * block
    last = F.least(first + F.size("_rows") - window, first + block - 1)
    starts = F.when(last >= first, F.sequence(first, last, F.lit(stride).cast("bigint")))
    if keep_short:
        starts = starts.when((F.col("_block") == 0) & (F.size("_rows") < window), F.array(first))
    cut = F.transform(
        starts,
        lambda s: F.struct(
            s.alias("start"),
            F.slice("_rows", (s - first + 1).cast("int"), window).alias("rows"),
        ),
    )
    return packed.select(*keys, F.explode(cut).alias("_w")).select(*keys, "_w.start", "_w.rows")


def dense_ids(
    df: DataFrame, order: list[str], name: str, *, partitions: int | None = None, kind: str = "int"
) -> DataFrame:
    """Add ``name``, a dense 1-based number over the unique global order ``order``.

    Rows are range-partitioned along their own distribution and written, so that partition number and place are
    stored facts, and the rows of earlier partitions are added from a table with one row per partition. A value
    of the leading column that most rows share is parted by the columns after it.
    """
    df = materialise(df, "ids")
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    ranged = materialise(ranged.withColumn("_m", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_p", F.shiftright("_m", 33))
    parts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_m") - F.shiftleft(F.col("_p"), 33)
    # one row per partition of the range shuffle: bounded by the partition count
    return ranged.join(F.broadcast(parts), "_p").withColumn(
        name, (F.col("_before") + place + 1).cast(kind)
    ).drop("_m", "_p", "_before")


def value_buckets(df: DataFrame, value: str, keys: list[str] = (), buckets: int = VALUE_BUCKETS) -> Column:
    """Equal-width bucket of ``value`` between the global minimum and maximum; monotone in ``value``.

    Only buckets that hold rows cost anything, so their number can be high enough for long-tailed values.
    """
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s")).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    place = F.floor((F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)) * buckets)
    return F.least(F.lit(buckets - 1), F.coalesce(place, F.lit(0))).cast("int")


def running_sums(
    df: DataFrame,
    keys: list[str],
    value: str,
    sums: list[str],
    *,
    descending: bool = False,
    buckets: int = VALUE_BUCKETS,
) -> DataFrame:
    """For each distinct ``value``: ``sums`` totals, ``cum_<s>`` up to and with it, ``all_<s>`` of the key.

    Rows are first merged per distinct value, then summed inside value buckets; the bucket totals, at
    most ``buckets`` per key, supply what came before. No key is ever sorted in one task.
    """
    merged = (
        df.withColumn("_b", value_buckets(df, value, keys, buckets))
        .groupBy(*keys, "_b", value)
        .agg(*[F.sum(s).alias(s) for s in sums])
    )
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = merged.groupBy(*keys, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    over_buckets = Window.partitionBy(*keys).orderBy(way("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_b",
        *[F.coalesce(F.sum(f"_t_{s}").over(over_buckets), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(Window.partitionBy(*keys)).alias(f"all_{s}") for s in sums],
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(way(value)).rowsBetween(Window.unboundedPreceding, 0)
    return join_null_safe(merged, offsets, [*keys, "_b"]).select(
        *keys,
        value,
        *sums,
        *[(F.col(f"_o_{s}") + F.sum(s).over(inside)).alias(f"cum_{s}") for s in sums],
        *[f"all_{s}" for s in sums],
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: list[str] = (), buckets: int = VALUE_BUCKETS
) -> DataFrame:
    """Quantiles with linear interpolation, one column per entry of ``probs``, one row per key.

    Exact like ``percentile`` but without its map of all distinct values: ranks are found from running
    counts over value buckets.
    """
    keys = list(keys)
    counted = running_sums(
        df.where(F.col(value).isNotNull()).select(*keys, value, F.lit(1).cast("bigint").alias("n")),
        keys, value, ["n"], buckets=buckets,
    )
    aggs = []
    for name, p in probs.items():
        rank = F.col("all_n").cast("double") - 1
        rank = rank * F.lit(float(p))
        low, high = F.floor(rank), F.ceil(rank)
        covers = lambda r: (F.col("cum_n") - F.col("n") <= r) & (r < F.col("cum_n"))
        aggs += [
            F.max(F.when(covers(low), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(covers(high), F.col(value))).alias(f"_hi_{name}"),
            F.max(rank - low).alias(f"_f_{name}"),
        ]
    found = counted.groupBy(*keys).agg(*aggs)
    return found.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probs
        ],
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key is a value like any other; the keys come from ``left``."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of a total order; runs as TakeOrdered, without a full sort."""
    return df.orderBy(*order).limit(k)




def rank_within(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each key with ``rank``.

    Catalyst turns the limit on the rank into a limit per key on the map side, so a hot key sends at
    most ``k`` rows per task; this holds for ``k`` up to ``spark.sql.optimizer.windowGroupLimitThreshold``.
    """
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def rank_boundaries(
    df: DataFrame, keys: list[str], slice_of: Column, order: list[Column], ranks: DataFrame, cuts: list[str]
) -> DataFrame:
    """For each key, the order value (struct) of the row at each 0-based rank of ``ranks``; null past the end.

    A selection without a sort: rows are counted per key and slice, which tells the slice that holds
    each wanted rank, and only the rows of these slices are then ranked. ``slice_of`` must be monotone
    in ``order``. ``ranks`` has one row per key with one bigint column per name in ``cuts``. The result
    is a written table with one row per key, to be compared row by row with the data.
    """
    rows = df.select(*keys, slice_of.alias("_slice"), F.struct(*order).alias("_order"))
    per_slice = rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    per_slice = per_slice.withColumn("_before", F.coalesce(before, F.lit(0)))
    wanted = small_table(ranks.select(*keys, *cuts), "ranks")
    long = wanted.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("_cut"), F.col(c).cast("bigint").alias("_rank")) for c in cuts
    ])))
    # the wanted ranks of a key meet only its slice counts
    met = per_slice.join(long, keys) if keys else per_slice.withColumn("_a", F.lit(0)).join(long.withColumn("_a", F.lit(0)), "_a")
    inside = (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
    located = small_table(
        met.where(inside).select(*keys, "_slice", "_cut", (F.col("_rank") - F.col("_before")).alias("_place")), "located"
    )
    near = rows.join(located, [*keys, "_slice"])
    place = F.row_number().over(Window.partitionBy(*keys, "_slice", "_cut").orderBy("_order")) - 1
    found = near.withColumn("_at", place).where(F.col("_at") == F.col("_place"))
    picks = [F.max(F.when(F.col("_cut") == c, F.col("_order"))).alias(c) for c in cuts]
    if not keys:
        return small_table(found.agg(*picks), "boundaries")
    return small_table(wanted.select(*keys).join(found.groupBy(*keys).agg(*picks), keys, "left"), "boundaries")
