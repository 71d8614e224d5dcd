"""Extraction, classifiers, tokens, search and the pipeline."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from logspark.llm import bpe, secrets, sitetree, topk, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

# extraction

PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/x>Menu</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">Cookies</div>
<main><article><header><h1>A &amp; B</h1></header><p><b>First  line<br>goes on<p>Second &lt;tag&gt; &#233;</p>
<form><input value=v>Send</form><aside>More</aside><blockquote>Said</blockquote></article>
<section class="comments"><p>I agree</p></section></main><footer>&copy; me</footer></body></html>"""


def test_extract_keeps_the_article():
    assert sitetree.extract(PAGE, set()) == "A & B\nFirst line goes on\nSecond <tag> é\nSaid"
    for odd in (None, "", "<", "<p", "<!--", "<script>x", "<p>a</b></div>"):
        sitetree.extract(odd, set())
    assert sitetree.extract("plain  text", set()) == "plain text"
    assert sitetree.extract("<nav>only a menu</nav>", set()) == ""
    long = "".join(f"<p>{i}</p>" for i in range(20_000))
    assert sitetree.extract(long, set()).count("\n") == 19_999


def test_low_branches_are_the_repeated_ones(spark):
    rows = [(i, "http://h.org/a", f"<body><div class=box>same</div><div class=text>own {i}</div></body>") for i in range(60)]
    rows += [(100, None, None), (101, "no url", ""), (102, "http://h.org/b", "<body><div class=box>same</div></body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in sitetree.extract_pages(pages).collect()}
    assert all(got[i] == f"own {i}" for i in range(60))
    assert got[100] == got[101] == "" and got[102] == "same"
    assert sitetree.extract_pages(pages.limit(0)).count() == 0
    clash = pages.selectExpr("*", "'x' as text", "'y' as host")
    assert sitetree.extract_pages(clash).where("page_id = 3").first()["text"] == "own 3"


def test_attributes_are_read_one_by_one():
    for kept in (
        '<p title="a hidden gem">t</p>', '<div data-role="form">t</div>', "<div title='class=ad'>t</div>", '<article><h2 class="section header">t</h2></article>',
        '<article><div class="side-by-side">t</div></article>', '<article><div class="related work">t</div></article>', '<article><div class="ad-hoc">t</div></article>',
    ):
        assert sitetree.extract(kept, set()) == "t", kept
    for gone in ('<div hidden>t</div>', "<div class='x ad'>t</div>", "<div ROLE=navigation>t</div>", '<article><div class="ad-box">t</div></article>', '<article><div id=comments>t</div></article>'):
        assert sitetree.extract(gone, set()) == "", gone


def test_deep_nesting():
    deep = "<div>" * 5000 + "t" + "</div>" * 5000 + "<p>u</p></x>"
    assert sitetree.extract(deep, {"/none"}) == "t\nu"
    seen = list(sitetree.styles(deep))
    assert len(seen) == 5001 and max(len(path) for path, _, _ in seen) <= sitetree.LONGEST_PATH
    assert sitetree.extract("<article>" + deep + "</article>", {"/article/div", "/article"}) == "u"
    two = "<div><article>a</article><article>b</article></div><div>c</div>"
    assert sitetree.extract(two, {"/div", "/div/article"}) == "a\nb"


def test_small_hosts_lose_what_they_repeat(spark):
    page = "<body><div class=box>same</div><article><h1>Title</h1><p>own {i} {h}</p></article></body>"
    rows = [(10 * h + i, f"http://h{h}.org/{i}", page.format(i=i, h=h)) for h in range(3) for i in range(h + 1)]
    plain = "<body><div class=box>same</div><div class=text>own {i}</div></body>"
    rows += [(100 + i, "http://plain.org/", plain.format(i=i)) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in sitetree.extract_pages(pages).collect()}
    assert all(got[10 * h + i] == f"Title\nown {i} {h}" for h in (1, 2) for i in range(h + 1))
    assert all(got[100 + i] == f"own {i}" for i in range(3))
    tree = {(r["host"], r["path"]): r for r in sitetree.style_tree(pages.select(sitetree.host("url").alias("host"), "html")).collect()}
    assert tree["h2.org", "/body/div.box"]["importance"] == 0 and tree["h2.org", "/body/article"]["importance"] == pytest.approx(1)
    assert tree["", "/body/div.box"]["n"] == 9 and tree["h0.org", "/body/div.box"]["importance"] == 1


def test_importance_is_relative_to_the_article(spark):
    rows = [(i, "http://h.org/a", "<body><article><p>copied text</p></article></body>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in sitetree.extract_pages(pages).collect()} == {"copied text"}


# toxicity


def test_toxicity_learns_from_the_training_fold_only(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        toxic = int(rng.random() < 0.2)
        text = [rng.choice("the of and to in is that for it as".split()) for _ in range(rng.randint(5, 60))]
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["rotten", "vile"])
        rows.append((i, " ".join(text), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (9000, ""), (9001, "x " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_report(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert {d for d, r in got.items() if r["held_out"] and d is not None and d < 9000} == {r[0] for r in held}
    right = sum(got[d]["predicted"] == toxic for d, _, toxic in held)
    assert right / len(held) > 0.98
    assert 0 <= got[9000]["score"] < 0.7 and got[9000]["predicted"] == 0 and got[None]["held_out"] is False
    swapped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity_report(docs, swapped).collect()} == {d: r["score"] for d, r in got.items()}
    nothing = toxicity.toxicity_report(docs, labels.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5}
    clash = docs.selectExpr("*", "1.5 as score")
    assert toxicity.drop_toxic(clash, toxicity.fit(docs, labels)).columns == ["doc_id", "text", "score"]


# secrets


def test_secrets_tell_tokens_from_numbers(spark):
    rng = random.Random(9)
    hexes = "0123456789abcdef"
    rows = []
    for i in range(300):
        secret = "".join(rng.choice(hexes) for _ in range(40))
        number = "".join(rng.choice("0123456789") for _ in range(16))
        filler = " ".join(rng.choice(["plain", "words", "around", "here"]) for _ in range(8))
        rows.append((i, f'{filler} token = "{secret}" {filler} {number} {filler} see a/path/to/file-2024-01-{i}.html'))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, rows[0][1])], "doc_id long, text string")
    got = secrets.label_by_assignment(secrets.scan(docs)).collect()
    assert len(got) >= 600 and sum(r["is_secret"] != bool(r["label"]) for r in got) == 0
    assert all(rows[r["doc_id"]][1][r["start"] : r["start"] + r["n_chars"]] == r["value"] for r in got if r["doc_id"] is not None)
    plain = docs.where("doc_id >= 900")
    assert secrets.scan(plain).count() == 0 and secrets.secret_report(docs.limit(0)).count() == 0


def test_secrets_learn_from_all_texts_and_findings(spark, monkeypatch):
    rare = "concat('rare', translate(cast(floor((id - 1) / 3) as string), '0123456789', 'abcdefghij'))"
    docs = spark.range(30_000).selectExpr("id as doc_id", f"case when id between 1 and 90 then {rare} else 'common' end as text")
    words = secrets.learn_language(docs).words
    assert len(words) == 31 and "common" in words
    counted = spark.createDataFrame([("b", 5), ("a", 5), ("d", 3), ("c", 3), ("e", 3), ("f", 9)], "word string, n long")
    kept = [sorted(secrets.most_frequent(counted, k)) for k in (1, 4, 6, 9)]
    assert kept == [["f"], ["a", "b", "c", "f"], list("abcdef"), list("abcdef")]
    assert secrets.most_frequent(counted.limit(0), 3) == {}

    class Forest:
        def __init__(self, **options):
            pass

        def fit(self, rows):
            return rows.count()

    monkeypatch.setattr(secrets, "RandomForestClassifier", Forest)
    findings = spark.range(120_000).selectExpr("id as doc_id", "0 as start", "cast(id % 2 as int) as label", "array(1.0d) as features")
    assert secrets.fit(findings.unionAll(findings.limit(5).selectExpr("doc_id", "start", "cast(null as int)", "features"))) == 120_000


# tokens


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(VOCABULARY)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_match_the_library(spark, ranks, library):
    rng = random.Random(1)
    parts = ["a", "é", " ", "  ", "\n", "\t", "中", "12", "'s", "!", "the", " ing", "\r\n", "🎉", "\x1c", " ", "word", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += ["x" * 5000, "ab " * 20_000, "<|endoftext|>"]
    docs = spark.createDataFrame([*enumerate(texts), (9000, None), (None, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.token_report(docs, VOCABULARY, public_tokenizers.PATTERN, words=True).collect()}
    for doc, text in [*enumerate(texts), (9000, ""), (None, "")]:
        ids = library.encode_ordinary(text)
        assert got[doc]["n_tokens"] == len(ids)
        assert got[doc]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.token_report(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 as n_tokens")
    assert bpe.encode_documents(clash, VOCABULARY, public_tokenizers.PATTERN).columns == ["doc_id", "text", "n_tokens", "ids"]


def test_whole_words_change_nothing(ranks):
    plain, fast = (bpe.Encoder(ranks, public_tokenizers.PATTERN, words) for words in (False, True))
    for text in ("a b  c\n d", " lead", "trail ", "x\n\n y", "don't stop", ""):
        assert plain.encode(text) == fast.encode(text)


def test_prefix_tables_follow_appends_and_edits(ranks):
    vocabulary, rng = bpe.Vocabulary(ranks), random.Random(2)
    for _ in range(60):
        data = bytes(rng.choice(b"abcde the") for _ in range(rng.randint(0, 150)))
        table = bpe.Prefixes(vocabulary, data[:40])
        table.append(data[40:])
        assert b"".join(vocabulary.tokens[t] for t in table.tokens()) == data
        a = rng.randint(0, len(data))
        b = min(len(data), a + rng.randint(0, 5))
        table.edit(a, b, new := bytes(rng.choice(b"abcthe") for _ in range(rng.randint(0, 5))))
        assert table.last == bpe.Prefixes(vocabulary, data[:a] + new + data[b:]).last
    far = bpe.Prefixes(vocabulary, b"the cat sat on the mat " * 200)
    assert far.edit(4, 7, b"dog") < 200


def test_unreachable_tokens_occur_only_whole():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"abc": 4, b"ab": 5}
    odd = bpe.Encoder(ranks, r"\S+")
    library = tiktoken.Encoding("odd", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "abcabc", "ab", "aab", "cabcb"):
        assert list(array("I", odd.encode(text))) == library.encode_ordinary(text)


# search


def best(rows, step=100, k=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in kept:
        if q % step == 0:
            clamped = lambda s: max(-(2**63), min(2**63 - 1, s))
            found = sorted((-clamped(sum(a * b for a, b in zip(x, y))), i) for i, y in kept if i != q)[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.1, 1e-3, 1e12])
def test_search_is_exact(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", 3)
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=20) * scale]) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2100, [1.0, None]), (2200, [float("nan")] * 20), (2300, [float("inf")] * 20), (2400, []), (2500, [0.5, 2.0]), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k_of_table(frame).collect())
    assert got == best(rows)
    few = frame.where("vec_id in (0, 1, 2)")
    assert len(topk.top_k_of_table(few).collect()) == 2
    assert topk.top_k_of_table(frame.limit(0)).count() == 0


# pipeline


def test_pipeline_keeps_clean_documents(spark, documents, tmp_path, library):
    rng = random.Random(7)
    common = "the of and to in is that for it as".split()
    rows, toxic = [], set()
    for i in range(400):
        text = [rng.choice(common) + rng.choice(["", str(rng.randint(0, 99))]) for _ in range(rng.randint(60, 90))]
        if i % 5 == 0:
            text[::7] = ["vile"] * len(text[::7])
            toxic.add(i)
        rows.append((i, " ".join(text), "ab"[i % 2]))
    rows += [(500, rows[1][1], "a"), (501, rows[2][1].replace("the", "teh", 1), "b"), (502, None, "a"), (503, "", None)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in got}
    assert not kept & toxic and kept <= {i for i in range(400) if i not in toxic}
    clean = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        clean = stage(spark, clean, str(tmp_path))
        assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = {r["doc_id"] for r in clean.collect()}
    assert left >= {i for i in range(400) if i not in toxic} and 501 not in left
    mixed = corpus_pipeline.STAGES[3][1](spark, clean, str(tmp_path)).collect()
    want = sorted((r["doc_id"], len(library.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in mixed)
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got) == want
