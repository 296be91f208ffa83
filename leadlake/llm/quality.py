"""Quality rules, line first: drop lines that fail, then documents that lose too much text.

Native: DataFrame expressions only, one pass, no shuffle.

Lines are judged for punctuation, navigation, boilerplate, symbols and capitals; a line equal to an
earlier one goes too. A document is kept if enough of its word characters stay.

Defined cases: a null text has no words and fails the base rules. Lines without a word are neither
kept nor counted. Texts of any length are judged whole. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import SPACE_CHAR, WORD, text_or_empty

SYMBOLS = "#*$%&|<>"
LINE_SYMBOLS = SYMBOLS + "{}=~^\\"
TERMINAL = [".", "!", "?", "…", ":", ";", ",", '"', "'", "”", "’", "»", ")", "]", "。", "！", "？"]
SEPARATORS = "|»›·>"
MENU = (
    r"^\W*(home|menu|main menu|log ?in|sign (in|up)|register|next|previous|back to top|share|search|sitemap|contact( us)?|about( us)?|"
    r"skip to content|read more)\W*$"
)
BOILERPLATE = [
    "all rights reserved", "copyright ©", "copyright (c)", "cookie policy", "cookie settings", "we use cookies", "privacy policy",
    "terms of use", "terms of service", "enable javascript", "subscribe to", "newsletter", "click here", "lorem ipsum", "released under the",
]


def occurrences(characters: str, text: Column) -> Column:
    """How many of the ``characters`` are in ``text``; the quick test spares most texts the slower count."""
    some = "[" + "".join("\\" + c for c in characters) + "]"
    return F.when(text.rlike(some), F.char_length(text) - F.char_length(F.translate(text, characters, ""))).otherwise(0)


def characters(lines: str) -> Column:
    return F.aggregate(lines, F.lit(0), lambda total, line: total + F.char_length(line))


def line_passes(line: Column, short_words: int, symbol_share: float) -> Column:
    """The line rules; the line has at least one word."""
    def judge(low: Column) -> Column:
        headless = ~F.right(F.rtrim(low), F.lit(1)).isin(TERMINAL) & (F.size(F.split(F.trim(low), SPACE_CHAR + "+", short_words)) < short_words)
        symbols = occurrences(LINE_SYMBOLS, low) > F.char_length(low) * symbol_share
        shouts = (F.upper(line) == line) & line.rlike(r"\p{Lu}(\P{Lu}*\p{Lu}){11}")
        navigation = (occurrences(SEPARATORS, low) >= 3) | low.rlike(MENU)
        boilerplate = functools.reduce(Column.__or__, [low.contains(phrase) for phrase in BOILERPLATE])
        return ~(headless | symbols | shouts | navigation | boilerplate)

    return let(F.lower(line), judge)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once, also where ``then`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), then), 0)


def word_windows(words: Column) -> Column:
    """Hashes of the three-word windows, in text order."""
    def of(hashed: Column) -> Column:
        window = F.transform(hashed, lambda w, i: F.xxhash64(w, F.get(hashed, i + 1), F.get(hashed, i + 2)))
        return F.slice(window, 1, F.greatest(F.size(hashed) - 2, F.lit(0)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def covered(windows: Column) -> Column:
    """How many words the windows cover that have an equal one, from the window hashes in text order."""
    pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    twins = let(pairs, lambda ps: F.filter(ps, lambda p, j: (p["w"] == F.get(ps, j - 1)["w"]) | (p["w"] == F.get(ps, j + 1)["w"])))
    places = F.sort_array(F.transform(twins, lambda p: p["i"]))
    gaps = let(places, lambda at: F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)


def clean_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, keep_share: float = 0.5, short_words: int = 5,
    symbol_share: float = 0.1,
) -> DataFrame:
    """(doc_id, base counts, base_failed, kept, kept_share, clean_text) for every row of ``docs``."""
    body = F.col("body")

    def measured(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            word_windows(words).alias("windows"),
        )

    words = F.filter(F.split(body, SPACE_CHAR + "+"), lambda w: w != "")
    windows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("body")).select(
        "doc_id", occurrences(SYMBOLS, body).cast("long").alias("n_symbols"), let(words, measured).alias("words"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    ).select("doc_id", "n_symbols", "words.*", "lines")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    counted = windows.withColumn("distinct_lines", F.array_distinct("lines")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "distinct_lines", characters("lines").alias("all_chars"),
        (F.size("lines") - F.size("distinct_lines")).cast("long").alias("n_dup_lines"),
        F.when(repeats, covered(F.col("windows"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.filter("distinct_lines", lambda line: line_passes(line, short_words, symbol_share)).alias("good"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    clean = F.array_join("good", "\n")
    judged = counted.withColumn("clean_text", clean).withColumn("base_failed", failed)
    shared = judged.withColumn("kept_share", F.when(F.col("all_chars") > 0, characters("good") / F.col("all_chars")).otherwise(0.0))
    return shared.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("kept_share") >= keep_share)).alias("kept"), "kept_share", "clean_text",
    )
