"""Quality rules by line-first cleaning [native].

Lines are judged first: sentence punctuation, navigation bars, boilerplate phrases, symbol noise and shouting. Failing
lines are removed; a document that loses more than half its words to them is rejected, and so is one that fails the
base counts. Everything is an expression over one row: no shuffle, no Python, and a hot source or a group of copies
changes nothing.

Cases: null and empty texts have no words, all counts 0, and fail the base rule. Repeated rows, ties and null ids or
sources are judged row by row. A text of any length is judged whole. Extra columns are carried by ``clean``, whatever
their names. ``judge`` gives doc_id and what it finds, and carries no other column. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import words

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]+"
#: A sentence ends in the line, or at its end; the latter is asked of lines of fewer words than ``SHORT``.
SENTENCE_END = r"[.!?;:…。！？][\"'’”»)\]]*(?:\s|$)"
LINE_END = r"[.!?;:…。！？][\"'’”»)\]]*\s*$"
SHORT = 8
#: Phrases of pages rather than of their texts.
BOILERPLATE = (
    r"(?i)\b(?:cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|"
    r"click here|sign up for|subscribe (?:now|to our)|skip to (?:main )?content|share on (?:facebook|twitter)|lorem ipsum|"
    r"add to cart|powered by)\b"
)
#: Separators of navigation bars.
NAVIGATION = r"\s(?:\||»|›|·|>|/)\s"


def _matches(text: Column, pattern: str) -> Column:
    return F.size(F.split(text, pattern)) - 1


def line_passes(line: Column, max_symbols: float = 0.05, max_bars: float = 0.2) -> Column:
    """Blank lines pass: they carry no words."""
    n = F.size(words(line))
    length = F.length(line)
    symbols = length - F.length(F.regexp_replace(line, SYMBOLS, ""))
    capitals = F.length(F.regexp_replace(line, r"[^A-Z]+", ""))
    small = F.length(F.regexp_replace(line, r"[^a-z]+", ""))
    return (n == 0) | (
        F.when(n < SHORT, line.rlike(LINE_END)).otherwise(line.rlike(SENTENCE_END))
        & (symbols <= max_symbols * length)
        & (_matches(line, NAVIGATION) <= max_bars * n)
        & ~line.rlike(BOILERPLATE)
        & ((n < 5) | (capitals <= 3 * small))
    )


def repeated_words(w: Column, ordered: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more; ordered: (hash, start) of all windows, sorted."""
    twice = F.filter(ordered, lambda x, i: (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def judge(docs: DataFrame, text: str = "text", max_lost: float = 0.5, carry: str | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and clean_text: the text
    without failing lines, or the text itself where none fails. carry: a column that comes along."""
    docs = docs.select("doc_id", F.col(f"`{text}`").alias("_text"), *([F.col(f"`{carry}`").alias("_carried")] if carry else []))
    text = "_text"
    t = F.coalesce(F.col(text), F.lit(""))
    windows = F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))))
    windows = F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))
    out = (
        docs.withColumn("_w", words(F.col(text)))
        .withColumn("_ordered", F.sort_array(windows))
        .withColumn("_lines", F.split(t, "\n"))
        .withColumn("_full", F.filter("_lines", lambda x: x.rlike(r"[^ \t-\r]")))
        .withColumn("_good", F.filter("_lines", lambda x: line_passes(x)))
    )
    lost = F.size("_good") < F.size("_lines")
    out = out.withColumn("clean_text", F.when(lost, F.array_join("_good", "\n")).otherwise(F.col(text)))
    n_words = F.size("_w").cast("long")
    out = out.withColumns(
        {
            "n_words": n_words,
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_w"), F.col("_ordered")),
        }
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    left = F.size(words(F.col("clean_text")))
    out = out.withColumn("kept", ~F.col("base_failed") & (left >= (1 - max_lost) * F.col("n_words")))
    return out.drop("_text", "_w", "_ordered", "_lines", "_full", "_good")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their failing lines removed and n_chars, where there is one, counted anew."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_whole")
    # A projection with a non-deterministic column keeps the filter above it; pushed down, it would take the place of
    # each column it names with that column's expression, nested many times over.
    judged = judge(docs.select("doc_id", "text", whole), carry="_whole")
    kept = judged.withColumn("_stay", F.monotonically_increasing_id()).where("kept and _stay >= 0")
    new = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*(new[c].alias(c) if c in new else F.col(f"_carried.`{c}`") for c in docs.columns))
