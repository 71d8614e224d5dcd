"""Alignment of tokenizers, collocations and the quality classifier against brute force and held-out labels."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from logspark.llm import alignment, collocation, nbsvm

FIRST, SECOND = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))

# alignment

ODD = ["", None, " ", "  two  spaces ", "a\n b\t c", "▁x y", "<|endoftext|> <s> <0x41>", "naïve Übung 東京 ｆ", "x\x00y   z", "one", "one", "\x1c a \x85b", "'s 's  don't"]


def brute_alignment(texts):
    """Tokens of whole texts, every pair of tokens compared."""
    a, b = tokenizers.Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    a.encode_special_tokens = True
    chars, spare = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            chars[chr(byte)] = byte
        else:
            chars[chr(spare)], spare = byte, spare + 1
    rows, links = [], []
    for text in texts:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        bx = [bytes(chars[c] for c in a.id_to_token(i)) for i in x]
        by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or b"".join(bx) != (" " + text).encode() or b"".join(by) != (" " + text).encode():
            x, y, bx, by = [], [], [], []
        span = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))]
        sx, sy = span(bx), span(by)
        own = [(x[i], y[j]) for i, (s, e) in enumerate(sx) for j, (t, u) in enumerate(sy) if s < u and t < e]
        cut = sorted({e for _, e in sx} & {e for _, e in sy})
        groups = [
            ",".join(str(i) for i, (s, e) in zip(x, sx) if lo < e <= hi) + "|" + ",".join(str(i) for i, (s, e) in zip(y, sy) if lo < e <= hi)
            for lo, hi in zip([0, *cut], cut)
        ]
        links.append(own)
        rows.append([len(x), len(y), len(cut), len(own), ";".join(groups)])
    counts = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (_, second), n in counts.items():
        best[second] = max(best[second], n)
    for row, own in zip(rows, links):
        row += [sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own)]
    return rows


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 300)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 700)


def random_texts(n):
    rng = random.Random(5)
    parts = ["the", "token", "izer", "Ünï", "▁", "東京", "\n", " ", "  ", "\t", "42", "don't", "!!", "é", "\x00", " ", "🙂", "<s>"]
    return [rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_alignment_is_that_of_all_pairs(spark, documents):
    texts = ODD + random_texts(80) + ["long " * 3000 + "end"]
    docs = documents(list(enumerate(texts)) + [(None, "no id")]).withColumn("n_a", alignment.F.lit("clash")).repartition(3)
    expected = brute_alignment([*texts, "no id"])
    got = {r["doc_id"]: r for r in alignment.link_report(docs, FIRST, SECOND).collect()}
    for i, (n_a, n_b, n_groups, n_links, groups, n_best, count_sum) in zip([*range(len(texts)), None], expected):
        digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        assert list(got[i])[1:] == [n_a, n_b, n_groups, n_links, n_best, count_sum, digest], texts[i or 0][:80]
    whole = {r["doc_id"]: r for r in alignment.align_documents(docs, FIRST, SECOND).collect()}
    assert [whole[i]["groups"] for i in range(len(texts))] == [r[4] for r in expected[:-1]]
    assert whole[0]["source"] == "src0" and whole[0]["n_a"] == 0
    assert alignment.link_report(docs.limit(0), FIRST, SECOND).count() == 0


def test_alignment_in_slices_is_the_same(small_slices):
    texts = ODD + random_texts(40) + ["a long text of words " * 200]
    pair = alignment.Pair(*[open(p, "rb").read() for p in (FIRST, SECOND)])
    found = alignment.align_texts(pair, texts, keep=True)
    for result, row in zip(found, brute_alignment(texts)):
        assert [result.n_a, result.n_b, result.n_groups, result.n_links, "".join(result.spelled)] == row[:5]
        assert result.digest.hexdigest() == hashlib.sha256(row[4].encode()).hexdigest()


# collocations


def brute_collocations(rows, threshold, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for c in ".,;:!?\n\x0b\x0c\r":
            text = (text or "").replace(c, "\n")
        for piece in text.translate(lower).split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    f = {p: c for p, c in f.items() if c >= threshold}
    out, inside = defaultdict(list), defaultdict(int)
    for p, a in f.items():
        for i in range(1, len(p)):
            for k in range(i + 1, len(p) + 1):
                if k - i < len(p) - 1:
                    inside[(p[0], *p[i:k])] = max(a, inside[(p[0], *p[i:k])])
    for p, a in f.items():
        lang, w = p[0], p[1:]
        if len(w) > 1 and inside.get(p, 0) < a:
            cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])
    )


def phrase_rows(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "c", "d", "é", "Ff", "\x00", "x\x1fy"]
    glue = [" ", " ", " ", "\t", "  ", ". ", "!", "\n", " \x0b", ","]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randint(0, 40)))
        rows.append((text + ("the same old phrase" if i % 3 == 0 else ""), rng.choice(["en", "en", "de", None])))
    return rows + [(None, "en"), ("", None), (" . ", "fr"), ("one two", "fr")] * 2


@pytest.mark.parametrize(("seed", "shards", "threshold"), [(1, 4, 12), (2, 2, 30)])
def test_collocations_are_exact(spark, seed, shards, threshold):
    rows = phrase_rows(seed, 90)
    docs = spark.createDataFrame([(t, lang, 0) for t, lang in rows], "text string, lang string, phrase int").repartition(3)
    counted = collocation.frequent_phrases(docs, threshold, shards=shards)
    for top in (2000, 3):
        got = collocation.ranked(*counted, top, 100)
        assert sorted(map(tuple, got.collect())) == brute_collocations(rows, threshold, top)


def test_false_entries_of_the_bitmaps_do_no_harm(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    rows = [(" ".join(rng.choice(words[: rng.choice([5, 60])]) for _ in range(80)), "en") for _ in range(150)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    counted = collocation.frequent_phrases(docs, threshold=6, shards=2, bits=15)  # some 2,000 entries in 32,768 cells
    assert sorted(map(tuple, collocation.ranked(*counted, 2000, 100).collect())) == brute_collocations(rows, 6)


def test_folded_bitmaps_have_all_entries():
    rng = np.random.default_rng(3)
    for entries, size in ((0, 1024), (3, 1024), (1000, 1 << 14), (600_000, 1 << 23)):
        hashes = rng.integers(0, 1 << 63, entries, dtype=np.uint64) * np.uint64(2)
        packed = np.zeros(1 << (collocation.CELLS_BITS - 3), np.uint8)
        at = collocation.cells(hashes, collocation.CELLS_BITS)
        np.bitwise_or.at(packed, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        small = collocation.folded(packed)
        assert len(small) <= size * 8
        assert collocation.Bitmaps({"hot": small}).has("hot", hashes).all()
        assert collocation.Bitmaps({"hot": small}).has("hot", rng.integers(0, 1 << 63, 10_000, dtype=np.uint64)).mean() < 0.2


@pytest.mark.parametrize("size", [1, 2, 50, 1 << 15, 1 << 31])
def test_distinct_rows_are_those_of_all_columns(size):
    rng = np.random.default_rng(size % 97)
    columns = [rng.integers(max(0, size - 4), size, 2000) for _ in range(5)]
    distinct, times = collocation.same(columns, size)
    expected = Counter(zip(*[c.tolist() for c in columns], strict=True))
    assert dict(zip(zip(*[c.tolist() for c in distinct], strict=True), times.tolist(), strict=True)) == expected


def test_only_phrases_not_hot_yet_are_summed(spark, monkeypatch):
    written = {}
    plain = collocation.materialise

    def kept(df, name):
        written[name] = plain(df, name)
        return written[name]

    monkeypatch.setattr(collocation, "materialise", kept)
    counts = spark.createDataFrame([("en", "a", 1, 9), ("en", "b", 1, 7), ("en", "c", 1, 1)], "lang string, phrase string, words int, n long")
    hot = spark.createDataFrame([("en", "a", 1, 0, 1)], "lang string, phrase string, words int, since int, hot_at int")
    new = collocation.newly_hot([counts, counts], [collocation.often_seen(counts, 8, 2)] * 2, hot, 1, 8, 2)
    assert [tuple(r) for r in new.collect()] == [("en", "b", 1, 0, 2)]
    assert [r["phrase"] for r in written["phrases-summed"].collect()] == ["b"]


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocation.collocations(docs).count() == 0


def test_very_long_pieces_are_cut_without_loss():
    rng = random.Random(1)
    text = "".join(rng.choice("abc") * rng.randint(1, 6) + rng.choice([" ", " ", "\t", "  ", " . "]) for _ in range(3000)) + "z" * 500
    whole, cut = Counter(), Counter()
    every = collocation.Bitmaps({k: np.full(1 << (collocation.CELLS_BITS - 3), 255, np.uint8).tobytes() for k in ("hot", "fresh")})
    for count, size in ((whole, 1 << 20), (cut, 100)):
        for data, own in collocation.slices([text, None, "a b"], 5, size):
            for _, phrases, times in collocation.phrases_in(data, own, "en", every, True, 5):
                count.update(dict(zip(phrases.to_pylist(), times.tolist(), strict=True)))
    assert whole == cut and len(whole) > 1000


# quality


def quality_rows(n, rng):
    words = [f"{a}{b}" for a in ("the", "an", "in", "ver", "so") for b in ("", "ly", "er", "ing", "st")]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        w = [rng.choice(words) for _ in range(rng.randint(8, 60))]
        text = " ".join(w).capitalize() + "."
        if not good:
            kind = i % 3
            text = [text.upper().replace(" ", "!! "), " | ".join(w), " ".join([w[0]] * len(w))][kind]
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def test_quality_learns_from_the_training_fold_only(spark, documents):
    rows, labels = quality_rows(400, random.Random(8))
    fold = [zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows]
    # wrong labels in the held-out fold must not matter
    marks = spark.createDataFrame([(i, 1 - y if out else y) for (i, y), out in zip(labels, fold)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in nbsvm.quality_report(documents(rows), marks).collect()}
    assert [got[i]["held_out"] for i, _ in rows] == fold
    wrong = [i for (i, y), out in zip(labels, fold) if out and got[i]["predicted"] != y]
    assert len(wrong) <= 0.02 * sum(fold)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())


def test_quality_on_odd_rows(spark, documents):
    rows, labels = quality_rows(120, random.Random(9))
    odd = [(None, None), (None, ""), (500, "word " * 50_000), (501, None), (3, rows[3][1]), (3, rows[3][1])]
    marks = spark.createDataFrame([*labels, (None, 1), (500, None), (3, 1 - labels[3][1])], "doc_id long, quality int")
    docs = documents(rows + odd).selectExpr("*", "'x' as score", "'y' as label", "'z' as places")
    model = nbsvm.fit(docs, marks)
    scored = nbsvm.score(docs, model)
    assert scored.count() == len(rows) + len(odd) and scored.where("label = 'y' and score between 0 and 1").count() == len(rows) + len(odd)
    empty = {r["score"] for r in scored.where("coalesce(text, '') = ''").collect()}
    assert len(empty) == 1
    for some in (marks.limit(0), marks.where("quality = 1")):
        scores = {r["score"] for r in nbsvm.quality_report(docs, some).collect()}
        assert len(scores) == 1 and (scores == {0.5}) == (some.count() == 0)
    assert nbsvm.quality_report(docs.limit(0), marks).count() == 0


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 4)), rng.integers(0, 2, 40)
    weights, alpha, cost = np.zeros(5), np.zeros(40), np.array([1.0, 1.0])
    rows = [(np.arange(4), v) for v in x]
    for n in range(200):
        nbsvm.descend(rows, y, weights, alpha, cost, n)
    side = np.where(y == 1, 1.0, -1.0)
    primal = weights @ weights / 2 + np.maximum(0, 1 - side * (x @ weights[:-1] + weights[-1])).sum()
    dual = alpha.sum() - weights @ weights / 2
    assert abs(primal - dual) < 1e-3 * primal


def test_a_task_of_quality_rounds_sends_one_vector():
    shard = {"labels": np.int32([0, 1]).tobytes(), "sizes": np.int32([2, 1]).tobytes(), "found": np.int32([0, 1, 2]).tobytes()}
    batches = [pa.RecordBatch.from_pylist([{"shard": i, **shard}]) for i in range(3)]
    ratio, state = (SimpleNamespace(value=v) for v in (np.array([-1.0, -0.5, 1.0]), (np.zeros(4), {}, [10.0, 10.0])))
    rows = [r for b in nbsvm.one_round(ratio, state, 0)(batches) for r in b.to_pylist()]
    alone = [r for x in batches for b in nbsvm.one_round(ratio, state, 0)([x]) for r in b.to_pylist() if r["w"]]
    (moved,) = [np.frombuffer(r["w"]) for r in rows if r["w"]]
    assert len(alone) == 3 and moved.any() and np.allclose(moved, sum(np.frombuffer(r["w"]) for r in alone))
    last = [r for b in nbsvm.one_round(ratio, state, nbsvm.ROUNDS)(batches) for r in b.to_pylist()]
    assert [r["shard"] for r in last] == [0, 1, 2] and not any(r["w"] for r in last)
