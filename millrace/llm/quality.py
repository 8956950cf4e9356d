"""Quality rules, line first: lines that fail a rule go, and documents that lose too much text with them.

Built-in functions only; each document is judged by itself, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import WORD, words_of

#: Lines that a site repeats on all its pages.
BOILERPLATE = (
    # The look ahead spares most places the list.
    r"(?i)(?:(?=[acjlprst])\b(?:all rights reserved|cookies?\b.{0,60}\b(?:accept|use|policy)|privacy policy|terms of (?:use|service)|click here"
    r"|subscribe|sign (?:in|up)|log ?in|javascript|powered by|licensed under|released under the)\b|^\s*(?:©|\(c\)|copyright)\s)"
)
#: Menus and crumbs: words between separators.
NAVIGATION = r"[|»›·•]"
#: What a sentence may end with.
STOPS = r"[.!?…。！？:;][\"'”’»)\]]*[\x20\x09-\x0D]*$"
SYMBOL = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """Parameters: a line fails with that share of separators or symbols to words, with two stops to most words (shouting),
    or if it ends without a stop though it has fewer words than short_line. kept: at most max_lost of the words are in such lines."""

    symbols_per_word: float = 0.3
    separators_per_word: float = 0.3
    shouts_per_word: float = 0.3
    short_line: int = 3
    max_lost: float = 0.6


def line_fails(line: Column, n: Column, rules: Rules) -> Column:
    """Whether one line of n words, one at least, is to be removed."""
    return (
        (F.regexp_count(line, F.lit(SYMBOL)) > rules.symbols_per_word * n)
        | (F.regexp_count(line, F.lit(NAVIGATION)) > rules.separators_per_word * n)
        | (F.regexp_count(line, F.lit(r"[!?]{2,}")) > rules.shouts_per_word * n)
        | ((n < rules.short_line) & ~line.rlike(STOPS))
        | ((n < 25) & line.rlike(BOILERPLATE))
    )


def _base(docs: DataFrame, text_col: str) -> DataFrame:
    """docs as the column d, with arrays of words and of lines that have a word, and the counts."""
    text = F.coalesce(F.col(f"d.{text_col}"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("d"))
    rows = rows.select("d", words_of(text).alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    windows = F.sequence(F.lit(1), F.size("words") - 4)
    # Hashes of windows tell which texts may have one twice; only those are read window by window and sorted. Equal windows
    # are then neighbours, and their places give the words they cover.
    hashes = F.when(F.size("words") > 5, F.transform(windows, lambda i: F.xxhash64(F.slice(F.col("words"), i, 5))))
    placed = F.array_sort(F.transform(windows, lambda i: F.struct(F.array_join(F.slice(F.col("words"), i, 5), " ").alias("g"), i.alias("i"))))
    rows = rows.select("d", "words", "lines", hashes.alias("hashes"))
    rows = rows.select("d", "words", "lines", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), placed).alias("placed"))
    twice = F.filter(
        "placed",
        lambda x, k: ((k > 0) & (F.get("placed", k - 1)["g"] == x["g"])) | ((k + 1 < F.size("placed")) & (F.get("placed", k + 1)["g"] == x["g"])),
    )
    at = F.array_sort(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    return rows.select(
        "d",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row for each row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    lost_words, clean_text, kept.

    Whole texts are read; null has no words. clean_text has the lines that passed (null for null). n_repeat_words counts
    words in windows of five words found twice or more in the text. base_failed: fewer than 10 words, or over a fifth of
    them repeated. kept: not base_failed, and no more than rules.max_lost of the words in removed lines.
    Repeated rows give repeated rows; extra columns may have any name.
    """
    rows = _base(docs, text_col)
    counted = F.transform("lines", lambda x: F.struct(x.alias("x"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    rows = rows.withColumn("passed", F.filter(counted, lambda x: ~line_fails(x["x"], x["n"], rules)))
    left = F.aggregate("passed", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    rows = rows.withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "lost_words": F.col("n_words") - left,
    })
    return rows.select(
        F.col(f"d.{id_col}").alias(id_col),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words",
        F.when(F.col(f"d.{text_col}").isNotNull(), F.array_join("passed.x", "\n")).alias("clean_text"),
        (~F.col("base_failed") & (F.col("lost_words") <= rules.max_lost * F.col("n_words"))).alias("kept"),
    )
