"""Quality rules: a threshold table compiled into column expressions of one projection.

Every metric is a Catalyst expression over one row, so the rules need no shuffle and no user function.
Null and empty texts have no words and fail the base rule. Rows, ids and further columns pass through as
they are; repeated rows are judged alike.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.words import SPACES, split_words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as with was on be at by this are or an from not have but "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es dem im "
    "le la les de des et un une du en que qui est pour dans par sur au pas ce il elle avec "
    "el los las y del que en un una por con para es se no su lo como más al"
).split()
#: As written inside, at the start of and throughout a shouted sentence.
STOP_FORMS = sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})


class Rule(NamedTuple):
    """A document passes while ``least <= metric <= most``."""

    metric: str
    least: float | None
    most: float | None


#: The threshold table; any list of the same shape can be passed to ``apply_rules``.
RULES = [
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("shout_ratio", None, 0.30),
    Rule("stop_word_ratio", 0.08, None),
    Rule("dup_line_ratio", None, 0.50),
]


def repeated_words(hashes: Column) -> Column:
    """Words covered by five-word windows whose hash occurs twice or more.

    Windows are sorted with their positions, so equal ones are neighbours; the covered words follow from
    the gaps between the sorted positions of repeated windows.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeats(rows: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(rows, j)["h"] == x["h"], F.lit(False))
        kept = F.filter(rows, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0).cast("bigint"), lambda total, n: total + n)

    once = F.transform(F.array(placed), lambda rows: repeats(rows))
    return F.element_at(F.transform(once, lambda at: covered(at)), 1)


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts and ratios that the rules refer to."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    words = docs.withColumns({"_words": split_words(F.col("text")), "_lines": lines})
    words = words.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_words")
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)])
    )).otherwise(F.array().cast("array<bigint>"))
    counted = words.withColumns({
        "_windows": windows,
        "n_words": n.cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_shouts": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("bigint"),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(STOP_FORMS))).cast("bigint"),
    })
    repeated = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"), repeated_words(F.col("_windows"))
    ).otherwise(F.lit(0).cast("bigint"))
    per = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(F.lit(0.0))
    return counted.withColumns({
        "n_repeat_words": repeated,
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "shout_ratio": per("n_shouts", "n_words"),
        # one more of each, so that a short text without stop words is no proof
        "stop_word_ratio": (F.col("n_stop_words") + 1) / (F.col("n_words") + 1),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
    }).drop("_words", "_lines", "_hashes", "_windows")


def passes(rule: Rule) -> Column:
    bounds = [F.col(rule.metric) >= rule.least] if rule.least is not None else []
    bounds += [F.col(rule.metric) <= rule.most] if rule.most is not None else []
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def apply_rules(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with its metrics, ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    taken = [c for c in docs.columns if c in {"_words", "_lines", "_hashes", "_windows"}]
    if taken:
        raise ValueError(f"reserved column names: {taken}")
    rows = measure(docs).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")),
    )
    failed = F.array_compact(F.array(*[F.when(~passes(r), F.lit(r.metric)) for r in rules]))
    return rows.withColumn("failed_rules", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )
