"""Line deduplication by winnowing: shared runs of lines are found from a few fingerprints and deleted where they come later.

Lines are numbered per document without those that hold no word. A gram is the shortest run of lines from a line
on that has ``gram_words`` words, a span the shortest that has ``span_words``. From the grams inside each span
the one with the smallest hash is a fingerprint (the later one of equals). Equal runs have equal spans, so two
copies of a run of ``span_words`` words or more share a fingerprint, whatever stands around them.

Documents are in order of id (null first) and text hash. Each fingerprint is joined to its first position, the
match is extended both ways over equal lines, by ``span_words`` words at most on either side, and the lines of
the later copy are deleted. So a line is deleted only as part of a repeated run of ``gram_words`` words or more, a copy of
every line stays, and of each repeated run of ``span_words`` words at least the fingerprints' grams go, with what
the first copies have around them.
A copy that overlaps its own first position keeps the overlap.

A first position may have other surroundings than a later one that holds more of the run. With ``every``, all
shortest runs of ``span_words`` words, from each line on and up to each line, are therefore compared with those of
every position of a repeated fingerprint, by one minimum per run. They cover every longer run, so each line of a
run of ``span_words`` words or more that any earlier place holds is deleted, but for such overlaps.

Arrays that a lambda looks things up in are columns used at least twice outside of filters; Catalyst would else
move their definitions into the lambda and evaluate them once per line.

All is column expressions, aggregates and joins. A frequent passage is one row per occurrence, aggregated before
it is shuffled and never paired with its other copies. Null texts stay null; lines without words stay where they
are; rows with equal id and text are one document and fare alike; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.words import SPACES, split_words
from logspark.session import materialise

GRAM_WORDS = 25
SPAN_WORDS = 50
#: A table of no more runs than this (some 20 bytes each) is sent to the texts.
BROADCAST_RUNS = 1_000_000
KEY = ["doc_id", "text_hash"]


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) != ""


def reach(words: Column, at: Column, wanted: int) -> Column:
    """Last line of the shortest run from line ``at`` with ``wanted`` words; null if the text ends before."""
    step = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))

    def add(state: Column, n: Column) -> Column:
        more = F.struct((state["sum"] + n).alias("sum"), (state["n"] + 1).alias("n"))
        return F.when(state["sum"] >= wanted, state).otherwise(more)

    # each line has a word, so no more than ``wanted`` lines are looked at
    run = F.aggregate(F.slice(words, at + 1, wanted), step, add)
    far = F.transform(F.array(run), lambda r: F.when(r["sum"] >= wanted, at + r["n"] - 1))
    return F.when(F.get(words, at) >= wanted, at).otherwise(F.element_at(far, 1))


def fingerprints(docs: DataFrame, gram_words: int = GRAM_WORDS, span_words: int = SPAN_WORDS) -> DataFrame:
    """``doc_id, text_hash, mark, first, last, before, after, spans``: fingerprints with their first and last line and
    the hashes of the lines around them, nearest first, up to ``span_words`` words on either side.

    ``spans`` has first line, last line and hash of the runs whose span the fingerprint is picked from: a run from
    a line on that is shortest, and those up to a line that are.
    """
    lines = F.filter(F.split("text", "\n"), has_word)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), lines.alias("lines")).select(
        *KEY, F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", lambda x: F.size(split_words(x))).alias("w")
    )
    numbers = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1))
    rows = rows.withColumns({
        "e": F.transform(numbers, lambda i: reach(F.col("w"), i, gram_words)),
        "s": F.transform(numbers, lambda i: reach(F.col("w"), i, span_words)),
    })
    gram = lambda i: F.when(F.get("e", i).isNotNull(), F.struct(
        F.xxhash64(F.slice("h", i + 1, F.get("e", i) - i + 1)).alias("mark"), (-i).alias("at"), F.get("e", i).alias("e")
    ))
    rows = rows.withColumn("g", F.transform(numbers, gram))

    def smallest(i: Column) -> Column:
        until = F.get("s", i)
        inside = F.filter(F.slice("g", i + 1, until - i + 1), lambda g: g["e"] <= until)
        best = F.when(until == i, F.get("g", i)).otherwise(F.array_min(inside))
        return F.when(until.isNotNull(), -best["at"])

    rows = rows.withColumn("k", F.transform(numbers, smallest))
    rows = rows.withColumn("p", F.array_sort(F.array_distinct(F.filter("k", lambda x: x.isNotNull()))))

    def spans_from(i: Column) -> Column:
        # a run that ends at a line before the next span does is the shortest up to that line
        until = F.get("s", i)
        last = F.greatest(until, F.coalesce(F.get("s", i + 1), F.size("h")) - 1)
        return F.transform(F.sequence(until, last), lambda j: F.struct(
            i.alias("low"), j.alias("high"), F.xxhash64(F.slice("h", i + 1, j - i + 1)).alias("span")
        ))

    def around(at: Column) -> Column:
        end, base = F.get("e", at), F.greatest(F.lit(0), at - span_words)
        # spans that start in these lines and end before the last of them: the lines after those have too few words
        ended = F.size(F.filter(F.slice("s", base + 1, at - base), lambda x: x < at - 1))
        low = F.greatest(F.lit(0), base + ended - 1)
        high = F.coalesce(F.get("s", end + 1), F.size("h") - 1)
        return F.struct(
            F.get("g", at)["mark"].alias("mark"), at.alias("first"), end.alias("last"),
            F.reverse(F.slice("h", low + 1, at - low)).alias("before"),
            F.slice("h", end + 2, F.greatest(high - end, F.lit(0))).alias("after"),
            F.flatten(F.transform(F.filter(F.sequence(base, at), lambda i: F.get("k", i) == at), spans_from)).alias("spans"),
        )

    found = rows.select(*KEY, F.explode_outer(F.transform("p", around)).alias("f"))
    return found.where(F.col("f").isNotNull()).select(*KEY, "f.*")


def equal_lines(a: Column, b: Column) -> Column:
    """Length of the common start of two arrays."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(
        F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z, i: F.when((z["x"] != z["y"]), i)), lambda i: i.isNotNull()
    )
    return F.least(n, F.coalesce(F.get(differ, F.lit(0)), n))


def repeated_spans(marks: DataFrame, sources: DataFrame) -> DataFrame:
    """``doc_id, text_hash, first, last``: shortest runs of ``span_words`` words that any earlier place holds."""
    spans = marks.join(sources.select("mark"), "mark").select(*KEY, F.explode("spans").alias("s")).select(*KEY, "s.*")
    spans = materialise(spans, "lines-spans")
    place = F.struct(F.col("doc_id").isNotNull().alias("has_id"), *KEY, "low")
    firsts = spans.groupBy("span").agg(F.min(place).alias("src"), F.max(place).alias("end")).where("src != end").drop("end")
    later = spans.join(materialise(firsts, "lines-firsts"), "span").where(place != F.col("src"))
    same = F.col("doc_id").eqNullSafe(F.col("src.doc_id")) & (F.col("text_hash") == F.col("src.text_hash"))
    free = F.col("src.low") + F.col("high") - F.col("low") + 1
    return later.select(*KEY, F.when(same, F.greatest("low", free)).otherwise(F.col("low")).alias("first"), F.col("high").alias("last"))


def repeated_runs(docs: DataFrame, every: bool = False, **options: int) -> DataFrame:
    """``doc_id, text_hash, first, last``: runs of lines (numbered without blank ones) that repeat an earlier run."""
    marks = materialise(fingerprints(docs, **options), "lines-marks")
    place = F.struct(F.col("doc_id").isNotNull().alias("has_id"), *KEY, "first")
    counted = marks.groupBy("mark").agg(F.min(place).alias("src"), F.max(place).alias("end")).where("src != end")
    sources = materialise(counted.drop("end"), "lines-sources")
    # the first position of each repeated mark, with the lines around it
    heads = marks.join(sources, "mark").where(place == F.col("src")).select(
        "mark", "src", F.col("last").alias("src_last"), F.col("before").alias("src_before"), F.col("after").alias("src_after")
    ).dropDuplicates(["mark"])
    met = marks.join(materialise(heads, "lines-heads"), "mark").where(place != F.col("src"))
    same = F.col("doc_id").eqNullSafe(F.col("src.doc_id")) & (F.col("text_hash") == F.col("src.text_hash"))
    low = F.col("first") - equal_lines(F.col("before"), F.col("src_before"))
    high = F.col("last") + equal_lines(F.col("after"), F.col("src_after"))
    gone = met.select(*KEY, F.when(same, F.greatest(low, F.col("src_last") + 1)).otherwise(low).alias("first"), high.alias("last"))
    gone = gone.where("first <= last")
    return gone.unionByName(repeated_spans(marks, sources)) if every else gone


def covered(runs: Column) -> Column:
    """Numbers of the lines in any of the runs, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["first"], r["last"])))))


def delete_repeats(docs: DataFrame, every: bool = False, **options: int) -> DataFrame:
    """``docs`` with later repeats cut from ``text``, and ``n_lines_deleted``; ``n_chars``, if there, follows.

    With ``every``, a run is compared with all earlier places, else with the first position of each fingerprint.
    """
    columns = [F.col(c) for c in docs.columns]
    narrow = docs.select("doc_id", "text")
    runs = repeated_runs(narrow, every, **options).groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("_runs"))
    if every:
        runs = materialise(runs.withColumn("_runs", covered(F.col("_runs"))), "lines-covered")
        edge = lambda step: F.filter(F.transform("_runs", lambda x, i: F.when(
            (i + step < 0) | ~F.coalesce(F.get("_runs", i + step) == x + step, F.lit(False)), x
        )), lambda x: x.isNotNull())
        runs = runs.withColumn("_runs", F.arrays_zip(edge(-1).alias("first"), edge(1).alias("last")))
    runs = materialise(runs, "lines-runs").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_runs")
    if (runs.agg(F.sum(F.size("_runs"))).first()[0] or 0) <= BROADCAST_RUNS:  # else Catalyst shuffles the texts
        runs = F.broadcast(runs)
    rows = docs.withColumn("_text_hash", F.xxhash64("text")).join(
        runs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left"
    )
    # numbers among the lines with words, then among all lines, then what is left
    gone = F.array_distinct(F.flatten(F.transform("_runs", lambda r: F.sequence(r["first"], r["last"]))))
    rows = rows.withColumns({"_gone": gone, "_lines": F.when(F.size("_runs") > 0, F.split("text", "\n"))})
    worded = F.filter(F.transform("_lines", lambda x, i: F.when(has_word(x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_worded", worded)
    out = F.when(F.size("_worded") > 0, F.transform("_gone", lambda n: F.get("_worded", n)))
    rows = rows.withColumn("_left", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), out))
    joined = F.when(F.size("_lines") > 0, F.array_join(F.transform("_left", lambda i: F.get("_lines", i)), "\n"))
    text = F.when(F.size("_runs") > 0, joined).otherwise(F.col("text"))
    done = rows.withColumn("text", text).withColumn("n_lines_deleted", F.greatest(F.size("_gone"), F.lit(0)).cast("bigint"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_lines_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint"))
    return done.select(*columns, "n_lines_deleted")


def line_report(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, n_lines, n_lines_deleted, n_words_left, text_md5`` of the text that is left."""
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    cut = delete_repeats(docs.select("doc_id", "text", lines.cast("bigint").alias("n_lines")), every=True)
    return cut.select(
        "doc_id", "n_lines", "n_lines_deleted", F.size(split_words(F.col("text"))).cast("bigint").alias("n_words_left"),
        F.md5("text").alias("text_md5"),
    )
