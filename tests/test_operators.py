import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.operators import alerts as al
from logspark.operators import evaluate as evl
from logspark.operators import features as ft
from logspark.operators import opsmetrics as om
from logspark.operators import sampling as sm
from logspark.operators import sequences as sq
from logspark.operators import templates as tp
from logspark.operators import thresholds as th
from logspark.operators import vectors as vc
from logspark.operators import windows as wn
from logspark.plans.queries import QUERIES
from logspark.schema import missing_columns, require
from logspark.sources import readers as rd


@pytest.fixture(scope="module")
def events_20(spark):
    rows = [(i, i, i, 1 if i >= 15 else 0, float(i)) for i in range(20)]
    return spark.createDataFrame(rows, "line_no bigint, template_id int, token_id int, label int, timestamp double")


@pytest.mark.parametrize("stride,n", [(5, 4), (1, 16)])
def test_sliding_sequences(events_20, stride, n):
    rows = {r.sequence_id: r for r in sq.sliding_sequences(events_20, ["timestamp", "line_no"], 5, stride).collect()}
    assert len(rows) == n and rows["window_0"].label == 0 and rows["window_5"].tokens == [5, 6, 7, 8, 9]
    assert rows["window_15"].label == 1


def test_short_input_gives_one_window(events_20):
    rows = sq.sliding_sequences(events_20, ["timestamp", "line_no"], 50, 10).collect()
    assert [(r.sequence_id, len(r.tokens), r.label) for r in rows] == [("window_0", 20, 1)]


def test_parse_sequences(spark):
    df = spark.createDataFrame([("s1", "1,2,3"), ("s2", "4, 5"), ("s3", ""), ("s4", None)], "session_id string, ordered_template_sequence string")
    assert [r.tokens for r in sq.parse_sequences(df).orderBy("session_id").collect()] == [[1, 2, 3], [4, 5], [], []]


def test_session_chunks_continue(events_20):
    keyed = events_20.withColumn("session_id", F.lit("s"))
    rows = sq.session_chunks(keyed, ["session_id"], ["timestamp", "line_no"], "token_id", chunk=8).orderBy("part").collect()
    assert [r.tokens for r in rows] == [list(range(8)), list(range(8, 16)), list(range(16, 20))]


@pytest.mark.parametrize("n,w,s,want", [(10, 5, 1, 6), (10, 5, 2, 3), (10, 5, 5, 2), (12, 4, 6, 2), (3, 5, 1, 0)])
def test_embedding_windows(spark, n, w, s, want):
    df = spark.range(n).select("id", F.array(F.col("id").cast("float")).alias("embedding"))
    assert sq.embedding_windows(df, [], ["id"], w, s, label=None).count() == want


def test_splits(spark):
    df = spark.range(100).select("id", (F.col("id") >= 80).cast("int").alias("label"))
    counts = {(r.label, r.split): r["count"] for r in sm.split_stratified(df, "id").groupBy("label", "split").count().collect()}
    assert counts == {(0, "test"): 8, (0, "val"): 8, (0, "train"): 64, (1, "test"): 2, (1, "val"): 2, (1, "train"): 16}
    ordered = sq.split_by_time(df, ["id"]).orderBy("id").collect()
    assert [r.split for r in ordered] == ["train"] * 80 + ["val"] * 10 + ["test"] * 10


def test_stratified_sample_is_exact(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"), (F.col("id") % 3).alias("g"))
    sample = sm.stratified_sample(df, ["label", "g"], "id", 101)
    assert sample.count() == 101
    assert sm.stratified_sample(df, ["label", "g"], "id", 1000).count() == 1000
    quotas = {(r.label, r.g): r.quota for r in sm.stratum_quotas(df, ["label", "g"], 101).collect()}
    assert {(r.label, r.g): r["count"] for r in sample.groupBy("label", "g").count().collect()} == quotas


@pytest.fixture(scope="module")
def dictionary(spark):
    return tp.fit_dictionary(spark.createDataFrame([("template C",), ("template A",), ("template B",), ("template A",)], "template_text string"))


def test_dictionary_encode_decode(spark, dictionary):
    assert [tuple(r) for r in dictionary.orderBy("template_id").collect()] == [(1, "template A"), (2, "template B"), (3, "template C")]
    ids = spark.createDataFrame([(1,), (3,), (999,)], "template_id int")
    assert {r.template_id: r.token_id for r in tp.encode(ids, dictionary).collect()} == {1: 3, 3: 5, 999: 1}
    tokens = spark.createDataFrame([(0,), (1,), (3,), (99,)], "token_id int")
    assert {r.token_id: r.text for r in tp.decode(tokens, dictionary).collect()} == {0: "<PAD>", 1: "<UNK>", 3: "template A", 99: "<UNK>"}
    assert tp.vocabulary(dictionary).count() == 5


def test_template_families(spark):
    texts = ["<NUM> a b c d e", "a b <IP> c d x", "<NUM> <IP>", ""]
    fitted = tp.fit_dictionary(spark.createDataFrame([(t,) for t in texts], "template_text string"))
    got = {r.family: len(r.tokens) for r in tp.template_families(fitted).collect()}
    assert got == {"a b c d": 2, "_other": 2}


def test_frequency_buckets(spark):
    df = spark.createDataFrame([(c,) for c in (1, 1, 2, 4, 5, 9, 10, 9999, 10000, 50000)], "count bigint")
    got = {r.freq_bucket: r.n_templates for r in tp.frequency_buckets(df).collect()}
    assert got == {"1": 2, "2-4": 2, "5-9": 2, "10-49": 1, "5k-9k": 1, "10k+": 2}


def stream(spark, n, keys=("s1",), labels=True):
    rows = [(f"bgl:{k}", float(i), i, i % 100 + 2, 0 if labels else None) for k in keys for i in range(n)]
    return spark.createDataFrame(rows, "stream_key string, timestamp double, line_no bigint, token_id int, label int")


@pytest.mark.parametrize("n", [9, 10, 14, 15, 1000])
def test_rolling_window_count_law(spark, n):
    rows = wn.rolling_windows(stream(spark, n), ["timestamp", "line_no"], 10, 5).collect()
    assert len(rows) == max(0, (n - 10) // 5 + 1 if n >= 10 else 0)
    assert {r.sequence_id for r in rows} == {f"bgl:s1_w{i}" for i in range(len(rows))}


def test_rolling_windows_keep_keys_apart_and_null_labels(spark):
    rows = wn.rolling_windows(stream(spark, 15, ("a", "b"), labels=False), ["timestamp", "line_no"], 10, 5).collect()
    assert len(rows) == 4 and all(r.label is None for r in rows)


def test_active_keys(spark):
    df = stream(spark, 3, ("A", "B", "C", "D")).withColumn("timestamp", F.col("timestamp") + F.ascii(F.substring("stream_key", 5, 1)) * 10)
    assert {r.stream_key for r in wn.active_keys(df, 3).collect()} == {"bgl:B", "bgl:C", "bgl:D"}


def brute_cooldown(rows, seconds):
    last, fired = {}, {}
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or t - last[key] >= seconds:
            last[key] = t
            fired[(key, i)] = True
        else:
            fired[(key, i)] = False
    return fired


@pytest.mark.parametrize("seed,seconds,segment", [(1, 60, 100), (2, 60, 1), (3, 7.5, 2), (4, 1, 3), (5, 500, 1)])
def test_cooldown_equals_replay(spark, seed, seconds, segment):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(30)}", round(rng.random() * 3000 - 500, rng.randrange(4)), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, t double, id bigint")
    got = {(r.k, r.id): r.fired for r in al.cooldown(df, "k", ["t", "id"], seconds, segment=segment).collect()}
    assert got == brute_cooldown(rows, seconds)


def test_cooldown_clock(spark):
    rows = [("a", 100.0, 1), ("a", 130.0, 2), ("a", 160.0, 3), ("b", 131.0, 4), ("b", 131.0, 5)]
    df = spark.createDataFrame(rows, "k string, t double, id bigint")
    flagged = al.cooldown(df, "k", ["t", "id"], 60)
    assert {r.id: r.fired for r in flagged.collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}
    assert {r.k: (r.fired, r.suppressed) for r in al.suppressed_counts(flagged, "k").collect()} == {"a": (2, 1), "b": (1, 1)}
    assert al.cooldown(df, "k", ["t", "id"], 0).where("fired").count() == 5


def test_alert_gate_policy(spark):
    df = spark.createDataFrame([(132.0, True, 10), (132.0, False, 10), (250.0, True, 2)], "risk_score double, is_anomaly boolean, window_size int")
    assert al.alert_gate(df).count() == 2
    assert al.alert_gate(df, min_score=200).count() == 1
    assert al.alert_gate(df, min_events=5).count() == 1


def replay_f1(scores, labels, lo, hi, n):
    best = (-1.0, None)
    for t in np.linspace(lo, hi, n):
        pred = scores >= t
        tp_, fp, fn = (pred & (labels == 1)).sum(), (pred & (labels == 0)).sum(), (~pred & (labels == 1)).sum()
        f1 = 2 * tp_ / (2 * tp_ + fp + fn) if 2 * tp_ + fp + fn else 0.0
        if f1 > best[0]:
            best = (f1, t)
    return best


@pytest.mark.parametrize("kind", ["separable", "noisy", "ties", "constant"])
def test_f1_threshold_equals_sweep(spark, kind):
    rng = np.random.default_rng(42)
    if kind == "separable":
        scores, labels = np.array([0.1, 0.2, 0.15, 0.9, 0.85, 0.95]), np.array([0, 0, 0, 1, 1, 1])
    elif kind == "constant":
        scores, labels = np.full(10, 0.5), np.array([0, 1] * 5)
    else:
        scores = np.r_[rng.normal(0.3, 0.1, 100), rng.normal(0.7, 0.15, 20)]
        labels = np.r_[np.zeros(100, int), np.ones(20, int)]
        scores = np.round(scores, 1) if kind == "ties" else scores
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(scores, labels, strict=True)], "score double, label int")
    got = th.f1_threshold(df).first()
    f1, t = replay_f1(scores, labels, np.percentile(scores, 1), np.percentile(scores, 99), 300)
    assert got.f1 == pytest.approx(f1) and got.threshold == pytest.approx(t)
    if kind == "separable":
        assert got.f1 == 1.0


def test_runtime_threshold_falls_back(spark):
    rows = [("few", float(i), 1 if i > 5 else 0) for i in range(10)] + [("one", float(i), 0) for i in range(50)]
    rows += [("good", float(i), 1 if i >= 45 else 0) for i in range(50)] + [("skew", float(i), 1 if i >= 5 else 0) for i in range(50)]
    got = {r.m: r.method for r in th.runtime_threshold(spark.createDataFrame(rows, "m string, score double, label int"), ["m"], 0.1).collect()}
    assert got == {"few": "percentile", "one": "percentile", "good": "f1", "skew": "percentile"}


def test_percentile_bounds(spark):
    df = spark.createDataFrame([(1.0, 0)], "score double, label int")
    for bad in (0, 101):
        with pytest.raises(ValueError):
            th.percentile_threshold(df, bad)


def test_auc_and_ap_on_known_values(spark):
    rows = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)]
    df = spark.createDataFrame(rows, "score double, label int")
    assert evl.roc_auc(df).first()[0] == pytest.approx(0.75)
    assert evl.average_precision(df).first()[0] == pytest.approx(0.8333333)


def test_confusion_counts_null_prediction_as_negative(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (0, 0), (1, None)], "pred int, label int")
    r = evl.confusion_metrics(df).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.total, r.skipped) == (1, 1, 1, 1, 4, 1)


def test_runtime_entropy_and_scalars(spark):
    df = spark.createDataFrame([("s", 1), ("s", 1), ("s", 2), ("s", 3)], "session_id string, template_id int")
    counts = ft.token_counts(df)
    r = ft.session_scalars(counts).first()
    assert (r.sequence_length, r.unique_count, r.unique_ratio) == (4, 3, 0.75)
    assert ft.session_entropy(counts).first().template_entropy == pytest.approx(1.5)


def test_single_event_session_has_no_bigram(spark):
    df = spark.createDataFrame([("s", 1, 1.0, 0)], "session_id string, template_id int, timestamp double, line_no bigint")
    assert ft.bigram_counts(ft.session_steps(df, ["timestamp", "line_no"])).count() == 0


def test_latency_summary_nearest_rank(spark):
    df = spark.createDataFrame([(float(i), float(i), i % 2 == 0) for i in range(1, 41)], "lat double, t double, hit boolean")
    r = evl.latency_summary(df, "lat", "t", "hit").first()
    assert (r.p95_latency, r.n_events, r.anomaly_rate_pct) == (38.0, 40, 50.0)


def test_bucket_quantile_above_last_bound(spark):
    df = spark.createDataFrame([(0.002,)] * 5 + [(9.0,)] * 5, "s double")
    buckets = om.latency_histogram(df, F.col("s"))
    assert om.bucket_quantile(buckets, 0.95).first()[0] == 1.0
    assert om.bucket_quantile(buckets, 0.25).first()[0] == pytest.approx(0.003)


def test_health_rollup(spark):
    rows = [("a", True, True), ("b", True, False), ("c", False, True), ("c", True, True)]
    df = spark.createDataFrame(rows, "s string, engine boolean, manager boolean")
    got = {r.s: (r.status, r.gauge) for r in om.health_rollup(df, ["s"], ["engine"], ["manager"]).collect()}
    assert got == {"a": ("healthy", 1.0), "b": ("degraded", 0.5), "c": ("unhealthy", 0.0)}


def test_keyword_topk_equals_replay(spark):
    rng = random.Random(3)
    words = ["alert", "al", "window", "win", "model", "x", "threshold", "old", "1"]
    docs = [(i, " ".join(rng.choices(words, k=6))) for i in range(12)]
    questions = [(i, " ".join(rng.choices([*words, "zzz"], k=rng.randrange(0, 5)))) for i in range(40)]
    q = spark.createDataFrame(questions, "qid bigint, q string")
    base = spark.createDataFrame(docs, "id bigint, text string")
    got = om.keyword_topk(q, "qid", "q", base, "id", F.concat_ws(" ", F.col("id").cast("string"), F.col("text"))).collect()
    for qid, text in questions:
        asked = set(text.lower().split())
        ranked = sorted(docs, key=lambda d: sum(w in f"{d[0]} {d[1]}".lower() for w in asked), reverse=True)[:3]
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == qid] == [d[0] for d in ranked]


def test_schema_gate(spark):
    df = spark.range(1).withColumn("old", F.lit(1))
    assert missing_columns(df, ["id", "message"], ["old"]) == [("message", "missing"), ("old", "must not exist")]
    with pytest.raises(ValueError):
        require(df, ["message"])


def test_keyword_topk_in_place_and_by_shuffle_agree(spark, monkeypatch):
    asked = [(1, "Alpha beta beta"), (2, "et"), (3, None), (4, "nothing here"), (5, "alpha gamma delta beta"), (6, "")]
    asked = spark.createDataFrame(asked, "q long, text string")
    base = [(10, "beta gamma"), (11, "alphabet"), (12, "delta"), (13, None), (14, "beta"), (15, "alpha")]
    base = spark.createDataFrame(base, "d long, body string")
    rows = lambda: sorted(map(tuple, om.keyword_topk(asked, "q", "text", base, "d", F.col("body"), 3).collect()))
    plan = om.keyword_topk(asked, "q", "text", base, "d", F.col("body"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    in_place = rows()
    monkeypatch.setattr(om, "INDEX_ROWS", -1)
    assert in_place == rows() and len(in_place) == 18


def test_text_parts_are_numbered_on(spark, tmp_path, monkeypatch):
    path, seen = str(tmp_path / "parts"), []
    spark.range(1000).repartitionByRange(4, "id").sortWithinPartitions("id").select(F.col("id").cast("string")).write.text(path)
    lines = rd.text_lines(spark, path, across=True).select("line_no", "line").collect()
    assert len(lines) == 1000 and all(r["line_no"] == int(r["line"]) for r in lines)
    read = rd.text_lines
    monkeypatch.setattr(rd, "text_lines", lambda s, p, **kw: seen.append(s.read.text(p).inputFiles()) or read(s, p, **kw))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        QUERIES["src_text_files"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(seen[0]) > 1


def test_embedding_joins_a_written_table(spark):
    """Its size is known before the join, so that events of a hot token are not shuffled."""
    vectors = spark.range(3).groupBy(F.col("id").alias("token")).agg(F.array(F.sum("id").cast("double")).alias("vector"))
    out = vc.embed_tokens(spark.range(9).select((F.col("id") % 4).alias("token")), vectors, "token", 1)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["vector"][0] for r in out.collect()) == [0.0] * 5 + [1.0, 1.0, 2.0, 2.0]
