"""Cooldown against a row-by-row replay: ties, borders of segments, rounding, null keys, one crowded key."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.operators import alerts as al


def replay(rows, seconds):
    last, out = {}, {}
    for key, at, item in sorted(rows, key=lambda r: (r[1], r[2])):
        fires = key not in last or at - last[key] >= seconds
        if fires:
            last[key] = at
        out[item] = fires
    return out


@pytest.mark.parametrize(("seconds", "step", "segment"), [(10.0, 1.0, 3), (0.3, 0.1, 2), (7.0, 0.01, 100), (5.0, 40.0, 1), (2.5, 0.5, 7)])
def test_cooldown_is_the_replay(spark, seconds, step, segment):
    rng = random.Random(int(seconds * 10))
    at, rows = {}, []
    for item in range(1500):
        key = rng.choice(["a", "a", "a", "b", None])
        at[key] = at.get(key, -50 * step) + rng.choice([0, 0, 1, 1, 2, 7, 300 if rng.random() < 0.02 else 1]) * step
        rows.append((key, at[key], item))
    df = spark.createDataFrame(rows, "k string, at double, item bigint").withColumn("_key", F.lit("kept")).drop("_key").repartition(5)
    got = {r["item"]: r["fired"] for r in al.cooldown(df, "k", ["at", "item"], seconds, segment).collect()}
    assert got == replay(rows, seconds)


def test_rows_without_a_time_do_not_fire(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 1.0, 2), ("b", None, 3)], "k string, at double, item bigint")
    assert {r["item"]: r["fired"] for r in al.cooldown(df, "k", ["at", "item"], 5.0).collect()} == {1: False, 2: True, 3: False}
    assert al.cooldown(df.limit(0), "k", ["at", "item"], 5.0).count() == 0


def test_next_firings_follow_the_rule_of_differences():
    rng = np.random.default_rng(4)
    times = np.sort(np.round(rng.random(3000) * 100, 1)) + 0.1
    far = al.next_firings(times, 0.3)
    assert all(f == next((j for j in range(len(times)) if times[j] - t >= 0.3), len(times)) for t, f in zip(times[::37], far[::37]))


def test_a_crowded_key_takes_linear_time(spark):
    """A million alerts of one key inside one cooldown."""
    df = spark.range(1_000_000).select(F.lit("hot").alias("k"), (F.col("id") / 1e5).alias("at"), F.col("id").alias("item"))
    begun = time.time()
    assert [r["item"] for r in al.cooldown(df, "k", ["at", "item"], 60.0).where("fired").collect()] == [0]
    assert time.time() - begun < 60
