"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a column expression over the text; `RULES` names bounds on ratios of these measures, and `compile_rules`
turns the table into a single boolean column. There are no user functions and no shuffle.

A null text has no words. A text with too few words, or with too many repeated 8-word windows, fails the base rules.
Lines and words are exact strings; ties and repeated rows are measured alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Frequent function words of the languages served (fixed values).
STOP_WORDS = tuple(
    "the be to of and that have with is in it for on as by an or "
    "der die das und ist von mit den ein eine nicht auf zu im für "
    "le la les de et des un une que est pour dans en du qui "
    "el los las y una por con no se su del al".split()
)


@dataclass(frozen=True)
class Rule:
    """Keep a text while low <= numerator / denominator <= high (a zero denominator counts as 1)."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float


RULES = (
    Rule("word_length", "word_chars", "n_words", 1.5, 20.0),
    Rule("symbol_ratio", "n_symbols", "n_words", 0.0, 0.3),
    Rule("stop_word_ratio", "n_stop", "n_words", 0.01, 1.0),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", 0.0, 0.5),
)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text."""

    def covered(starts: Column) -> Column:  # ascending starts of repeated windows
        n = F.size(starts)
        gaps = F.transform(starts, lambda s, i: F.when(i + 1 >= n, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(starts, i + 1) - s)))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    def repeated(pairs: Column) -> Column:  # (key, start) by key: equal keys are neighbours
        same = F.filter(pairs, lambda p, i: F.get(pairs, i - 1)["key"].eqNullSafe(p["key"]) | F.get(pairs, i + 1)["key"].eqNullSafe(p["key"]))
        return _let(F.array_sort(F.transform(same, lambda p: p["start"])), covered)

    def windows(ws: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
        return _let(keys, lambda ks: F.when(F.size(F.array_distinct(ks)) == F.size(ks), F.lit(0).cast("bigint")).otherwise(_let(F.array_sort(F.transform(ks, lambda k, i: F.struct(k.alias("key"), i.alias("start")))), repeated)))

    return F.when(F.size(words) > WINDOW, _let(words, windows)).otherwise(F.lit(0).cast("bigint"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, NOT_WORD), lambda w: w != "")
    base = docs.select(F.col(id_col), text.alias("_text"), words.alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.translate(line, SPACES, "") != "")
    stops = F.filter(F.col("_words"), lambda w: F.lower(w).isin(*STOP_WORDS))
    return base.select(
        F.col(id_col),
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.translate("_text", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size(stops).cast("bigint").alias("n_stop"),
    ).select(id_col, "n_words", "word_chars", "n_symbols", F.col("_lines.dup").cast("bigint").alias("n_dup_lines"), "n_repeat_words", F.col("_lines.n").cast("bigint").alias("n_lines"), "n_stop")


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column: every rule holds."""
    ok = F.lit(True)
    for r in rules:
        ratio = F.col(r.numerator) / F.greatest(F.col(r.denominator), F.lit(1))
        ok = ok & ratio.between(r.low, r.high)
    return ok


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures with base_failed and kept. Long texts are measured whole, in time n log n at worst."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measures(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
