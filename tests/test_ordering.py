"""Skew-safe primitives: cut and uncut plans must agree, also when one key holds most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.operators.ordering import (
    count_windows, dense_ids, exact_quantiles, rank_boundaries, running_sums, slice_width, value_buckets, with_position,
)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", float(rng.randrange(500)), i, rng.randrange(5)) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, t double, id bigint, v int").cache()


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r.t, r.id)):
        groups.setdefault(r.k, []).append(r)
    return groups


@pytest.mark.parametrize("target", [10_000_000, 100, 17])
@pytest.mark.parametrize("keys", [["k"], []])
def test_positions(skewed, target, keys):
    assert (slice_width(skewed, keys, "t", target) is None) == (target > 3000)
    got = with_position(skewed, keys, ["t", "id"], following={"nxt": "v"}, sizes=True, target_rows=target).collect()
    want = {}
    for group in (by_key(skewed.collect()) if keys else {"": sorted(skewed.collect(), key=lambda r: (r.t, r.id))}).values():
        for i, r in enumerate(group):
            want[r.id] = (i, group[i + 1].v if i + 1 < len(group) else None, len(group))
    assert {r.id: (r.pos, r.nxt, r.key_rows) for r in got} == want


@pytest.mark.parametrize("target,block", [(10_000_000, 2048), (50, 30), (50, 8)])
@pytest.mark.parametrize("window,stride", [(10, 5), (7, 1), (3, 8), (40, 12)])
def test_windows(skewed, target, block, window, stride):
    got = count_windows(skewed, ["k"], ["t", "id"], ["id"], window, stride, target_rows=target, block_rows=block, keep_short=True)
    want = []
    for k, group in by_key(skewed.collect()).items():
        ids = [r.id for r in group]
        want += [(k, s, ids[s:s + window]) for s in range(0, max(1, len(ids) - window + 1), stride)]
    assert sorted((r.k, r.start, [x.id for x in r.rows]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("partitions", [None, 1, 9])
def test_dense_ids(spark, partitions):
    words = sorted({f"w{random.Random(i).randrange(10**6):06d}" for i in range(300)})
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(7)
    got = dense_ids(df, ["w"], "i", partitions=partitions).collect()
    assert {r.w: r.i for r in got} == {w: i + 1 for i, w in enumerate(words)}


def test_dense_ids_with_one_leading_value(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4500, -1).otherwise(F.col("id")).alias("doc"), "id")
    got = dense_ids(df, ["doc", "id"], "i", partitions=8)
    assert [r.i for r in got.orderBy("doc", "id").collect()] == list(range(1, 5001))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2500


@pytest.mark.parametrize("buckets", [1, 16, 4096])
def test_quantiles(skewed, buckets):
    probs = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p66": 0.66, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in exact_quantiles(skewed, "t", probs, ["k"], buckets=buckets).collect()}
    for k, group in by_key(skewed.collect()).items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.percentile([r.t for r in group], p * 100), abs=1e-9)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(skewed, descending):
    df = skewed.select("k", "t", F.lit(1).alias("n"))
    got = {(r.k, r.t): (r.n, r.cum_n, r.all_n) for r in running_sums(df, ["k"], "t", ["n"], descending=descending, buckets=32).collect()}
    for k, group in by_key(skewed.collect()).items():
        times = [r.t for r in group]
        for t in set(times):
            upto = sum(x >= t for x in times) if descending else sum(x <= t for x in times)
            assert got[(k, t)] == (times.count(t), upto, len(times))


@pytest.mark.parametrize("keys", [["k"], []])
def test_rank_boundaries(skewed, keys):
    ranks = skewed.groupBy(*keys).agg(
        F.lit(0).cast("bigint").alias("first"), F.floor(F.count(F.lit(1)) / 3).alias("third"), F.count(F.lit(1)).alias("past"))
    order = [F.col("t"), F.col("id")]
    got = rank_boundaries(skewed, keys, value_buckets(skewed, "t", buckets=16), order, ranks, ["first", "third", "past"]).collect()
    groups = by_key(skewed.collect()) if keys else {None: sorted(skewed.collect(), key=lambda r: (r.t, r.id))}
    assert len(got) == len(groups)
    for r in got:
        group = groups[r.k if keys else None]
        assert (r.first.t, r.first.id) == (group[0].t, group[0].id)
        assert (r.third.t, r.third.id) == (group[len(group) // 3].t, group[len(group) // 3].id)
        assert r.past is None
