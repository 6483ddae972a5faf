"""Quality rules: a threshold table compiled into one projection of built-in functions.

Counts are taken over whole texts. A null text counts as empty, so it has no words and fails. A document's
verdict depends on its own text alone: repeated rows get equal verdicts and there are no ties. All columns
of the input stay, whatever they are called; a computed column replaces one of the same name. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, free_name, text_or_empty, words_of

#: Common words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "with", "have", "be", "for", "was", "on", "it", "a",
    "der", "die", "das", "und", "in", "zu", "den", "mit", "von", "ist", "des", "auf", "für", "nicht", "ein", "eine",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "que", "qui", "en", "dans", "pour", "par", "est",
    "el", "los", "las", "y", "del", "se", "por", "con", "para", "no", "su", "al", "lo",
)
MIN_WORDS = 50
#: Percent of the words that may lie in repeated windows.
MAX_REPEATED = 50
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """low <= measure / per <= high; an open side is None, and a measure per nothing is taken as it is."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("text_words", "n_words", low=MIN_WORDS, high=1e8),
    Rule("mean_word_length", "word_chars", "n_words", low=2.5, high=12),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("shouted_words", "n_shouted", "n_words", high=0.5),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.3),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.3),
)


def verdict(rules: Sequence[Rule]) -> Column:
    """The rules as one condition. Ratios are compared as products, so nothing is divided."""
    out = F.lit(True)
    for rule in rules:
        measure = F.col(rule.measure).cast("double")
        of = F.col(rule.per).cast("double") if rule.per else F.lit(1.0)
        if rule.low is not None:
            out = out & (measure >= F.lit(float(rule.low)) * of)
        if rule.high is not None:
            out = out & (measure <= F.lit(float(rule.high)) * of)
    return out


def verdict_sql(rules: Sequence[Rule]) -> str:
    """The same condition for another SQL engine."""
    out = []
    for rule in rules:
        of = f"{rule.per}::DOUBLE" if rule.per else "1.0::DOUBLE"
        if rule.low is not None:
            out.append(f"{rule.measure} >= {float(rule.low)!r}::DOUBLE * {of}")
        if rule.high is not None:
            out.append(f"{rule.measure} <= {float(rule.high)!r}::DOUBLE * {of}")
    return " AND ".join(out)


def _repeated_words(words: str, ordered: str) -> Column:
    """Words in windows of three that occur twice or more. Equal windows stand side by side once sorted, so
    a long text costs its length times the logarithm of it."""
    windows = F.col(ordered)
    rest = F.greatest(F.size(windows) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(windows, F.lit(1), rest),
        F.slice(windows, F.lit(2), rest),
        lambda x, y: F.when(x["k"] == y["k"], F.array(x["i"], x["i"] + 1, x["i"] + 2, y["i"], y["i"] + 1, y["i"] + 2)),
    )
    return F.size(F.array_distinct(F.flatten(F.array_compact(pairs)))).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures that the rules speak of, one row for one row."""
    words, lines, ordered = free_name(docs, "words", "lines", "ordered")
    t = text_or_empty(text)
    d = docs.withColumns(
        {
            words: words_of(t),
            lines: F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
            "word_chars": F.length(F.translate(t, BLANKS, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
            "n_shouted": F.regexp_count(t, F.lit("(?<![^ \\t-\\r])[^ \\t-\\ra-z]*[A-Z]{2}[^ \\t-\\ra-z]*+(?![^ \\t-\\r])")).cast("long"),
        }
    )
    w = F.col(words)
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW),
        lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.alias("i")),
    )
    d = d.withColumns(
        {
            ordered: F.when(F.size(w) > WINDOW, F.sort_array(windows)).otherwise(F.array().cast("array<struct<k:string,i:int>>")),
            "n_words": F.size(w).cast("long"),
            "n_stop_words": F.size(F.array_intersect(w, F.lit(list(dict.fromkeys(STOP_WORDS))))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_bullet_lines": F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[•*-]"))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$"))).cast("long"),
        }
    )
    d = d.withColumn("n_repeat_words", _repeated_words(words, ordered))
    return d.drop(words, lines, ordered)


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """docs with all measures, base_failed and kept."""
    d = measure(docs, text)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with the columns of docs. Measures are taken of a copy of the text, so that
    columns of docs that share a measure's name stay as they are. A filter on the verdict alone would be moved
    below the projections, with every measure written out wherever a rule names it; it may not pass a row
    number, so the measures are taken once."""
    rows = apply_rules(docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text")), rules, "__text")
    return rows.withColumn("__no", F.monotonically_increasing_id()).filter(F.col("kept") & (F.col("__no") >= 0)).select("__row.*")
