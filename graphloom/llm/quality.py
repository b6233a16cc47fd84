"""Line-first quality rules, in DataFrame functions only.

Every line of a text is judged by itself (sentence punctuation, navigation, boilerplate, symbols, shouting,
repetition); failing lines are removed, and a document that loses more than the allowed share of its word
characters is rejected, as is one that fails the two document-level base rules.

Defined results: a null or empty text has no words, fails the base rule and is not kept; a text of white space alone
likewise; extra columns pass through untouched; repeated rows are judged one by one; texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, words

#: Fixed values of the base rules' symbol count.
SYMBOLS = "#*$%&|<>"
#: A line of at most `notice_max_words` words that carries one of these phrases, whatever its case, is boilerplate.
BOILERPLATE = (
    "cookie", "javascript", "all rights reserved", "privacy policy", "terms of use", "terms of service",
    "lorem ipsum", "copyright", "released under the", "licensed under", "subscribe to our", "sign up for",
    "log in to", "share this",
)
#: Navigation: a line of NAV_ENTRIES or more short entries between these signs.
NAV_SIGNS, NAV_ENTRIES = r"\s[|»›•·/>→]+\s", 3
#: A line of prose closes with one of these; MARKS stand between the entries of menus or decorate junk.
TERMINAL = ".!?…:;,\"'”’»)]。！？：；，、"
MARKS = r"[#*$%&|<>{}=_~^\\»›·•]"


@dataclass(frozen=True)
class LineRules:
    """Limits in percent of a line's words, but shout_percent: of its characters, and max_loss_percent: of a document's word characters."""

    mark_percent: int = 20
    exclaim_percent: int = 40
    shout_percent: int = 50
    shout_min_chars: int = 12
    repeat_min_words: int = 20
    distinct_percent: int = 25
    nav_entry_words: int = 3
    notice_max_words: int = 40
    max_loss_percent: int = 40
    min_words: int = 50
    max_repeat_percent: int = 50


def occurrences(text: Column, pattern: str) -> Column:
    """Number of matches of a one-character pattern."""
    return F.size(F.split(text, pattern, -1)) - 1


def line_passes(line: Column, low: Column, w: Column, rules: LineRules) -> Column:
    """Whether a line is kept, given its lower-case form and its words; the cheapest tests come first."""
    n = F.size(w)
    spoken = F.lit(False)
    for phrase in BOILERPLATE:
        spoken = spoken | low.contains(phrase)
    # Language-independent: entries of a menu are few words each, whatever sign the line closes with.
    entries = F.size(F.split(line, NAV_SIGNS, -1))
    menu = (entries >= NAV_ENTRIES) & (n <= entries * (rules.nav_entry_words + 1))
    return (
        F.lit(TERMINAL).contains(F.right(F.rtrim(line, F.lit(SPACE_CHARS)), F.lit(1)))
        & (occurrences(line, MARKS) * 100 <= n * rules.mark_percent)
        & (occurrences(line, "[!?]") * 100 <= n * rules.exclaim_percent + 100)
        & (
            (F.length(line) < rules.shout_min_chars)
            | (occurrences(line, r"\p{Lu}") * 100 <= F.length(line) * rules.shout_percent)
        )
        & ((n < rules.repeat_min_words) | (F.size(F.array_distinct(w)) * 100 >= n * rules.distinct_percent))
        & ~((n <= rules.notice_max_words) & spoken)
        & ~(line.rlike(NAV_SIGNS) & menu)
    )


def _windows(w: Column, make) -> Column:
    """make(i) for the start i of every 3-word window of the word array; none with fewer words."""
    starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, make)


def window_hashes(w: Column) -> Column:
    return _windows(w, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))


def _repeated_words(df: DataFrame, w: str, hashes: str, out: str) -> DataFrame:
    """df with `out`: words covered by 3-word windows that occur at least twice in the word array.

    A text without equal window hashes has none. Otherwise its windows are sorted, the hash first and the words
    themselves to settle equal hashes, so the result is exact and the cost n log n. One column a step keeps the
    expressions shallow.
    """
    word, h, s, p = (F.col(c) for c in (w, hashes, "__sorted", "__places"))

    def window(i: Column) -> Column:
        k = F.concat_ws(" ", F.get(word, i), F.get(word, i + 1), F.get(word, i + 2))
        return F.struct(F.get(h, i).alias("h"), k.alias("k"), i.alias("i"))

    def twin(x: Column, other: Column) -> Column:
        return F.coalesce((other["h"] == x["h"]) & (other["k"] == x["k"]), F.lit(False))

    repeats = F.size(F.array_distinct(h)) < F.size(h)
    return (
        df.withColumn("__unsorted", F.when(repeats, _windows(word, window)))
        .withColumn("__sorted", F.sort_array("__unsorted"))
        .withColumn("__twins", F.filter(s, lambda x, i: twin(x, F.get(s, i - 1)) | twin(x, F.get(s, i + 1))))
        .withColumn("__places", F.sort_array(F.col("__twins.i")))
        .withColumn("__steps", F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))))
        .withColumn(out, F.coalesce(F.aggregate("__steps", F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
        .drop("__unsorted", "__sorted", "__twins", "__places", "__steps")
    )


def assess(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """docs with one struct column `quality`: counts, base_failed, cleaned text, its word characters, kept."""
    col = F.coalesce(F.col(text), F.lit(""))
    w, lines, line_words, lows, passed = (F.col(c) for c in ("__words", "__lines", "__line_words", "__lows", "__passed"))
    n, cleaned = F.size(w), F.col("__cleaned")
    failed = (n < rules.min_words) | (100 * F.col("__repeat") > rules.max_repeat_percent * n)
    word_chars, left = F.length(F.array_join(w, "")), F.length(F.array_join(F.col("__left"), ""))
    staged = docs.withColumns(
        {
            "__words": words(col),
            "__lines": F.filter(F.split(col, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    ).withColumn("__hashes", window_hashes(w))
    staged = (
        _repeated_words(staged, "__words", "__hashes", "__repeat")
        .drop("__hashes")
        .withColumns({"__line_words": F.transform(lines, words), "__lows": F.transform(lines, F.lower)})
        .withColumn(
            "__passed",
            F.filter(lines, lambda x, i: line_passes(x, F.get(lows, i), F.get(line_words, i), rules)),
        )
        .withColumn("__cleaned", F.array_join(passed, "\n"))
        .withColumn("__left", words(cleaned))
    )
    # The partition id keeps a later filter on the result from being rewritten in terms of the text, step by step.
    measured = staged.withColumn(
        "quality",
        F.when(F.spark_partition_id() >= 0, F.struct(
            n.cast("long").alias("n_words"),
            word_chars.cast("long").alias("word_chars"),
            occurrences(col, f"[{SYMBOLS}]").cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.col("__repeat").alias("n_repeat_words"),
            failed.alias("base_failed"),
            left.cast("long").alias("left_chars"),
            (~failed & (left * 100 >= word_chars * (100 - rules.max_loss_percent))).alias("kept"),
            cleaned.alias("cleaned"),
        )),
    )
    return measured.drop(
        "__words", "__lines", "__repeat", "__line_words", "__lows", "__passed", "__cleaned", "__left"
    )


def clean(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The kept documents, with their cleaned text; an n_chars column follows the new text."""
    out = assess(docs, text, rules).filter(F.col("quality.kept")).withColumn(text, F.col("quality.cleaned"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(F.col(text)).cast("long"))
    return out.drop("quality")
