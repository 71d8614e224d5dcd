"""Rules, near duplicates, line dedup, mixing and sharding against brute force and on edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from logspark.llm import linededup, mixing, neardup, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")

EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (None, "one two"), (None, None), (5, "word " * 30_000)]


def words(text):
    return WORD.findall(text or "")


# quality rules


def repeated(w):
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    return len({i + k for p in at.values() if len(p) > 1 for i in p for k in range(5)})


def test_quality_counts(documents):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "a#", "b", "of", "é|", "\n", "!"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(100 + i, t) for i, (_, t) in enumerate(EDGE)]
    got = {r["doc_id"]: r for r in quality.apply_rules(documents(rows)).collect()}
    for doc, text in rows:
        w, r = words(text), got[doc]
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeated(w)
        assert r["base_failed"] == (len(w) < 10 or 100 * repeated(w) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_quality_table_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "it is the law of the land and of the sea", "x")], "doc_id long, text string, n_words string")
    kept = quality.apply_rules(docs.drop("n_words"), [quality.Rule("n_words", 20, None)]).first()
    assert kept["failed_rules"] == ["n_words"] and not kept["kept"]
    assert quality.apply_rules(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        quality.apply_rules(docs.withColumnRenamed("n_words", "_words"))


# near duplicates


def components(rows):
    sets = []
    for _, text in rows:
        w = [x.encode().lower() for x in words(text)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    name = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            name[i] = min(ids) if ids else None
    return [(rows[i][0], len(sets[i]), name[i] if sets[i] else rows[i][0]) for i in range(len(rows))]


def test_near_duplicates_match_brute_force(documents):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, doc = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((doc, " ".join(copy)))
            doc += 1
    rows += [(500, rows[0][1].upper()), *EDGE]
    got = neardup.near_duplicates(documents(rows)).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(key, components(rows)))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_crowded_regions_lose_no_link(documents, monkeypatch):
    """More near copies than a small region takes, next to documents that share most of their text with them."""
    monkeypatch.setattr(neardup, "CROWDED", 3)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(40):
        copy = list(base)
        for k in range(1 if i < 20 else 3):
            copy[rng.randrange(100)] = f"x{i}-{k}"
        rows.append((i, " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents(rows)).collect()}
    assert got == {d: c for d, _, c in components(rows)}


def test_second_level_is_not_needed_for_a_link(documents, monkeypatch):
    """All classes in one crowded region, and a second level that brings none of them together."""
    monkeypatch.setattr(neardup, "CROWDED", 3)
    monkeypatch.setattr(neardup, "prefixes", lambda classes, level: classes.selectExpr("0L * cid" if level == 0 else "cid", "cid", "comp", "n").toDF("region", "cid", "comp", "n"))
    rng = random.Random(12)
    template = [f"t{i}" for i in range(140)]
    rows = []
    for pair in range(12):
        own = [f"p{pair}-{i}" for i in range(60)]
        for side in range(2):
            copy = [*template, *own]
            for k in range(2):
                copy[rng.randrange(200)] = f"x{pair}-{side}-{k}"
            rows.append((2 * pair + side, " ".join(copy)))
    want = {d: c for d, _, c in components(rows)}
    assert len(set(want.values())) == 12
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents(rows)).collect()} == want


def test_shingle_counts_send_no_empty_cells(spark, monkeypatch):
    sent, plain = [], type(spark.range(0)).repartition

    def kept(self, *args):
        sent.append(self)
        return plain(self, *args)

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 20, dtype=np.uint64)) for _ in range(30)]
    frame = spark.createDataFrame([(s.tobytes(),) for s in sets], "members binary")
    monkeypatch.setattr(type(frame), "repartition", kept)
    found = neardup.shingle_counts(frame, 22)
    expected = np.zeros(1 << 22, int)
    for s in sets:
        expected[np.unique(neardup.places(s, 22))] += 1
    assert (found == expected).all()
    assert sum(len(v) for r in sent[0].drop("block").collect() for v in r) < 10_000  # tables have 4 bytes a cell


def test_pipeline_gives_python_small_batches(spark, documents):
    import corpus_pipeline

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(k) for k in keys]
    try:
        corpus_pipeline.encoded(spark, documents([(1, "a")]), "")
        got = spark.range(0, 3000, 1, 1).mapInArrow(count, "n long").collect()
        assert max(r["n"] for r in got) <= 1000
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


@pytest.mark.parametrize("bits", [3, 22])
def test_rare_shingles_cover_all_similar_pairs(spark, bits):
    rng = np.random.Generator(np.random.PCG64(1))
    sets = {i: np.unique(rng.integers(0, 60, 50)).astype(np.uint64) * np.uint64(1 << 58 | 12345) for i in range(40)}
    frame = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "cid long, members binary")
    comps = spark.createDataFrame([(i, i, len(s)) for i, s in sets.items()], "cid long, comp long, n long")
    counts = neardup.shingle_counts(frame, bits)
    for value, times in Counter(x for s in sets.values() for x in s.tolist()).items():
        assert times <= counts[value >> (64 - bits)] <= len(sets)
    got = {(r["a"], r["b"]) for r in neardup.rare_shingle_pairs(frame, comps, bits).collect()}
    for i in sets:
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                assert (j, i) in got


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["cid"]: r["root"] for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_near_duplicates_of_nothing_and_extra_columns(documents):
    docs = documents([(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")])
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1]


# line dedup


def brute_lines(rows, gram_words=linededup.GRAM_WORDS, span_words=linededup.SPAN_WORDS):
    """The definition with plain loops; line hashes only choose among grams."""
    def reach(n, i, wanted):
        total = 0
        for j in range(i, len(n)):
            total += n[j]
            if total >= wanted:
                return j
        return None

    docs = {}
    for doc, text in rows:
        if text is not None:
            key = (doc is not None, doc if doc is not None else 0, np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64).item())
            docs[key] = [x for x in text.split("\n") if words(x)]
    hash_of = lambda x: np.uint64(xxhash.xxh64_intdigest(x.encode(), 42)).astype(np.int64).item()

    def chained(lines):
        seed = 42
        for line in lines:
            seed = xxhash.xxh64_intdigest(int(hash_of(line)).to_bytes(8, "little", signed=True), seed)
        return np.uint64(seed).astype(np.int64).item()

    marks = defaultdict(list)
    info = {}
    for key in sorted(docs):
        lines = docs[key]
        n = [len(words(x)) for x in lines]
        e = [reach(n, i, gram_words) for i in range(len(lines))]
        s = [reach(n, i, span_words) for i in range(len(lines))]
        picked = set()
        for i in range(len(lines)):
            if s[i] is not None:
                inside = [g for g in range(i, s[i] + 1) if e[g] is not None and e[g] <= s[i]]
                picked.add(min(inside, key=lambda g: (chained(lines[g : e[g] + 1]), -g)))
        p = sorted(picked)
        for g in p:
            low = next((j for j in range(g - 1, -1, -1) if s[j] is not None and s[j] < g - 1), 0)
            high = s[e[g] + 1] if e[g] + 1 < len(lines) and s[e[g] + 1] is not None else len(lines) - 1
            mark = tuple(lines[g : e[g] + 1])
            marks[mark].append((key, g))
            info[key, g] = (e[g], lines[low:g][::-1], lines[e[g] + 1 : high + 1])
    gone = defaultdict(set)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for places in marks.values():
        src = min(places)
        for place in set(places) - {src}:
            end, before, after = info[place]
            src_end, src_before, src_after = info[src]
            low = place[1] - common(before, src_before)
            if place[0] == src[0]:
                low = max(low, src_end + 1)
            gone[place[0]].update(range(low, end + common(after, src_after) + 1))
    out = {}
    for key, lines in docs.items():
        out[key] = [x for i, x in enumerate(lines) if i not in gone[key]]
    return out


def test_line_dedup_matches_brute_force(documents):
    rng = random.Random(6)
    pool = [" ".join(f"p{k}x{i}" for i in range(rng.choice([1, 4, 9, 20, 30, 60]))) for k in range(25)]
    rows = []
    for doc in range(100, 140):
        lines = []
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(pool) - 5)
            lines += pool[at : at + rng.randint(1, 6)]
            lines += ["", f"own{doc}-{len(lines)} line"]
        rows.append((doc, "\n".join(lines)))
    docs = documents([*rows, *EDGE])
    got = linededup.delete_repeats(docs).collect()
    want = brute_lines([*rows, *EDGE])
    left = sorted(repr([x for x in r["text"].split("\n") if words(x)]) for r in got if r["text"] is not None and r["doc_id"] != 4)
    assert left == sorted(repr(v) for k, v in want.items() if k[:2] != (True, 4))
    assert sum(r["n_lines_deleted"] for r in got) > 20
    survivors = {line for r in got for line in (r["text"] or "").split("\n")}
    assert survivors >= {line for _, t in rows for line in t.split("\n")}
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["n_lines_deleted"])


def test_line_dedup_finds_long_runs_in_any_surroundings(documents):
    run = [" ".join(f"r{i}w{k}" for k in range(13)) for i in range(5)]  # 65 words over five lines
    rows = [(1, "\n".join(["start one", *run, "end one"])), (2, "\n".join(["x", "y", *run, "z"])), (3, "\n".join(run))]
    got = {r["doc_id"]: r["text"] for r in linededup.delete_repeats(documents(rows)).collect()}
    assert got == {1: rows[0][1], 2: "x\ny\nz", 3: ""}
    short = documents([(1, "a b c"), (2, "a b c")])
    assert {r["text"] for r in linededup.delete_repeats(short).collect()} == {"a b c"}
    assert linededup.delete_repeats(short.limit(0)).count() == 0
    twice = documents([(1, "\n".join([*run, *run]))])
    assert linededup.delete_repeats(twice).first()["text"] == "\n".join(run)


def plain_lines(rows, span_words=linededup.SPAN_WORDS):
    """Ids to the lines that no run of ``span_words`` words or more, held by an earlier place, takes; all pairs of places."""
    docs = [(doc, [x for x in text.split("\n") if words(x)]) for doc, text in sorted(rows)]
    gone = [set() for _ in docs]
    for d, (_, lines) in enumerate(docs):
        for e in range(d + 1):
            for i in range(len(lines)):
                for j in range(len(docs[e][1]) if e < d else i):
                    n = 0
                    while i + n < len(lines) and j + n < len(docs[e][1]) and lines[i + n] == docs[e][1][j + n]:
                        n += 1
                    if sum(len(words(x)) for x in lines[i : i + n]) >= span_words:
                        gone[d].update(range(i if e < d else max(i, j + n), i + n))
    return {doc: [x for i, x in enumerate(lines) if i not in gone[d]] for d, (doc, lines) in enumerate(docs)}


def test_line_report_compares_with_every_earlier_place(documents):
    """A fingerprint's first position is a quote with other surroundings; the whole run stands in a later document."""
    run = [" ".join(f"{c}{i}w{k}" for k in range(n)) for i, (c, n) in enumerate(zip("abcdefg", (9, 12, 3, 30, 2, 14, 8), strict=True))]
    rows = [(i, "\n".join([f"q{i}", run[i], f"r{i}"])) for i in range(7)]  # each line is quoted alone
    rows += [(10 + i, "\n".join([f"s{i}", *run[i : i + 3], f"t{i}"])) for i in range(5)]
    rows += [(30, "\n".join(["x", *run, "y"])), (31, "\n".join([*run[2:], "v", *run])), (32, "\n".join(["z", *run[:5]]))]
    rng = random.Random(6)
    pool = [" ".join(f"p{k}x{i}" for i in range(rng.choice([1, 4, 9, 20, 30, 60]))) for k in range(25)]
    for doc in range(100, 130):
        at = [rng.randrange(20) for _ in range(rng.randint(0, 4))]
        rows.append((doc, "\n".join(x for k in at for x in [*pool[k : k + rng.randint(1, 6)], f"own{doc}-{k}"])))
    left = {r["doc_id"]: r["text"].split("\n") for r in linededup.delete_repeats(documents(rows), every=True).collect()}
    want = plain_lines(rows)
    assert left[31] == ["v"] and left[32] == ["z"]
    assert all(Counter(x for x in left[doc] if x) <= Counter(want[doc]) for doc in want)
    lost = lambda kept: any(Counter(kept[doc]) - Counter(want[doc]) for doc in want)
    assert lost({k[1]: v for k, v in brute_lines(rows).items()})  # first positions alone leave lines
    period = documents([(1, "\n".join(["two words"] * 26))])
    assert linededup.delete_repeats(period, every=True).collect() == linededup.delete_repeats(period).collect()
    assert {x for lines in left.values() for x in lines} >= {x for _, t in rows for x in t.split("\n") if x}
    report = {r["doc_id"]: r["n_words_left"] for r in linededup.line_report(documents(rows)).collect()}
    assert report == {doc: sum(len(words(x)) for x in lines) for doc, lines in left.items()}


# mixing


def water_fill(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not full:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in full:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("sources", [["a", "b", "c", None, "é"], ["a"], ["x", "y"]])
def test_mixing_meets_targets(documents, sources):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([0, 1, 5, 300, 2000]), rng.choice(sources + sources[:1] * 3)) for i in range(60)]
    rows += [(7, "same row", "a"), (7, "same row", "a"), (None, "no id here", "a"), (70, None, "a")]
    got = mixing.mix_report(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    want = water_fill(sizes)
    by_target = defaultdict(int)
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        by_target[round(r["target"], 6)] += r["taken"]
    expected = defaultdict(int)
    for s, t in want.items():
        expected[round(t, 6)] += round(t)
    assert set(by_target) == set(expected)
    assert all(abs(by_target[t] - expected[t]) <= len(sources) for t in expected)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix_report(documents(rows).repartition(5)).collect()))


def test_permutations_and_slots(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        keys = mixing.round_keys(F.lit(n), F.lit("t"))
        out = spark.range(n).select(mixing.permute(F.col("id"), F.lit(n), keys, F.lit("t")).alias("y"))
        assert sorted(r["y"] for r in out.collect()) == list(range(n))
    sources = spark.createDataFrame([(0, 5000, 7300.0), (1, 300, 600.0), (2, 0, 0.0)], "sid int, source_size long, target double")
    rows = mixing.slots(sources, shard_slots=4).collect()
    dealt = sorted(r["output_shard"] * 4 + r["slot"] for r in rows)
    assert dealt == list(range(len(rows)))
    total = Counter()
    for r in rows:
        total[r["sid"]] += r["words"]
    assert total == {0: 7300, 1: 600}


def test_mixed_documents_hold_what_was_taken(documents):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(200 * (i % 4))), "ab"[i % 2]) for i in range(20)]
    docs = documents(rows)
    report = {r["doc_id"]: r["taken"] for r in mixing.mix_report(docs).collect()}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(words(r["text"]))
        assert set(words(r["text"])) <= set(words(rows[r["doc_id"]][1])) and r["n_chars"] == len(r["text"])
    assert got == {d: n for d, n in report.items() if n}
    assert mixing.mix_report(docs.limit(0)).count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0


# sharding


def test_matrix_has_exact_margins():
    sizes = sharding.cell_sizes(1003, 7, 3)
    sent = [500, 0, 3, 500]
    matrix = sharding.communication_matrix(sent, sizes)
    assert (matrix.sum(axis=(1, 2)) == sent).all() and (matrix.sum(axis=0) == sizes).all() and matrix.min() >= 0
    shards = sizes.sum(axis=1)
    assert shards.sum() == 1003 and shards.max() - shards.min() <= 1
    big = sharding.communication_matrix([3 * 10**9, 10**9], sharding.cell_sizes(4 * 10**9, 2, 1))
    assert big.sum() == 4 * 10**9 and abs(int(big[0, 0, 0]) - 1.5e9) < 1e6


def test_matrix_follows_the_hypergeometric_mean():
    draws = [sharding.communication_matrix([30, 30], sharding.cell_sizes(60, 3, 1), seed)[0, 0, 0] for seed in range(400)]
    assert abs(np.mean(draws) - 10) < 0.4 and abs(np.var(draws) - 20 * 0.5 * 0.5 * 40 / 59) < 0.9


def test_sharding(documents):
    rows = [(i, f"text {i % 50}") for i in range(997)] + EDGE
    got = sharding.shard_documents(documents(rows)).collect()
    assert len(got) == len(rows)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    counts = [len(by_shard[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1
    size = {(r["doc_id"], r["size"], r["text_crc32"]) for r in got}
    assert size == {(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows}
    assert sharding.shard_documents(documents(rows).limit(0)).count() == 0
    again = sharding.shard_documents(documents(rows).repartition(3)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_places_documents_without_their_texts(documents, monkeypatch):
    """Only the last join moves texts; repeated rows hold their own words each."""
    written = {}
    real = mixing.materialise
    monkeypatch.setattr(mixing, "materialise", lambda df, name: written.setdefault(name, real(df, name)))
    rows = [(i, f"w{i} " * 30, "en", f"s{i % 2}", 0) for i in range(40)] + [(1, "w1 " * 30, "en", "s1", 0)] * 2
    docs = documents(rows)
    mixed = mixing.mix_documents(docs)
    assert "text" not in written["mix-placed"].columns and mixed.columns == docs.columns
    taken = sum(r["taken"] for r in mixing.mix_report(docs).collect())
    assert sum(len(r["text"].split()) for r in mixed.collect()) == taken
