"""Quality rules by line-first cleaning: DataFrame functions only.

Lines that break a line rule go first; then a document goes that loses too much of its
text, or that fails the base rules.  Every row is judged alone: no shuffle, no Python.

Cases: null text counts as empty (no words, rejected by the base rules); rows repeat as
often as they come; extra columns stay where the caller keeps them; an empty table gives
an empty result.  A text without words loses nothing and falls to the base rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import SPACE, WORD_GAP, free_prefix
from palisade.session import once


@dataclass(frozen=True)
class QualityRules:
    """Thresholds; the base rules are ``n_words`` and the share of repeated words."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    # A line of at least this many words must end like a sentence; shorter ones may be titles.
    prose_words: int = 6
    # A line with this many separators or more, and at least one to every two words, is navigation.
    nav_separators: int = 3
    # A document goes that keeps less than this share of its characters in words.
    min_kept_percent: int = 50


# Sentence ends, closing marks after them, navigation separators, and phrases
# of notices that pages repeat.
SENTENCE_END = r"[.!?…:;。！？][\"'”’»)\]*_]*$"
SEPARATOR = r"[|•·»>/]"
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "accept cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "sign up for our newsletter",
    "subscribe to our newsletter", "click here", "read more", "share on facebook", "share this",
    "skip to content", "back to top", "powered by", "licensed under",
)


def split_words(text: Column) -> Column:
    """The words of a text; none for null, empty or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def line_fails(line: Column, rules: QualityRules) -> Column:
    """Whether a line with at least one word breaks the punctuation, navigation or boilerplate rule."""
    bare = F.btrim(line, F.lit(SPACE))
    gaps = F.regexp_count(bare, F.lit(WORD_GAP))
    marks = F.regexp_count(bare, F.lit(SEPARATOR))
    nav = (marks >= rules.nav_separators) & (2 * marks >= gaps + 1)
    no_end = (gaps + 1 >= rules.prose_words) & ~bare.rlike(SENTENCE_END)
    return no_end | nav | F.lower(bare).rlike("|".join(BOILERPLATE))


def repeated_words(words: Column, window: int) -> Column:
    """Number of words inside a window of ``window`` words that the text holds twice or more.

    Windows are compared by a 64-bit hash built by doubling.  A sort of the plain hashes
    finds out whether any repeats; only then are positions sorted with them.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    have = 1
    while have * 2 <= window:
        hashes = _paired(hashes, have)
        have *= 2
    if have < window:  # the remaining words overlap: the two runs together name the window
        hashes = _paired(hashes, window - have)
    return hashes


def _paired(hashes: Column, step: int) -> Column:
    """Hash of each value with the one ``step`` places on, where there is one."""
    def pair(all_: Column) -> Column:
        n = F.size(all_) - step
        both = F.zip_with(F.slice(all_, F.lit(1), n), F.slice(all_, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))
        return F.when(n <= 0, F.array().cast("array<bigint>")).otherwise(both)

    return _let(hashes, pair)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a lambda a name would compute it again."""
    return F.transform(F.array(value), use)[0]


def _repeats(ordered: Column) -> Column:
    """Whether a sorted array holds a value twice."""
    return F.exists(F.zip_with(ordered, F.slice(ordered, F.lit(2), F.size(ordered)), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False)))


def _covered(windows: Column, window: int) -> Column:
    """Words covered by repeated windows, given all window hashes in text order."""
    found = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = _let(
        found,
        lambda pairs: F.transform(pairs, lambda p, i: F.when(
            ((i > 0) & (F.get(pairs, i - 1)["h"] == p["h"])) | (F.get(pairs, i + 1)["h"] == p["h"]), p["i"]
        )),
    )
    state = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    step = lambda s, p: F.struct(
        (s["total"] + p + window - F.greatest(s["end"], p)).cast("int").alias("total"), (p + window).cast("int").alias("end")
    )
    return F.aggregate(F.sort_array(F.array_compact(at)), state, step, lambda s: s["total"])


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", prefix: str = "q_") -> DataFrame:
    """``docs`` with ``prefix`` + n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_failed_lines, cleaned (the text without failed lines) and kept.

    Each costly array is a column of its own behind a projection that Catalyst keeps apart,
    so that it is computed once per row.
    """
    p = prefix
    body = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda s: F.btrim(s, F.lit(SPACE)) != ""
    df = docs.withColumns({f"{p}words": split_words(F.col(text)), f"{p}lines": F.split(body, "\n")})
    df = df.withColumns({
        f"{p}n_words": F.size(f"{p}words").cast("long"),
        f"{p}word_chars": F.aggregate(f"{p}words", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)),
        f"{p}windows": repeated_words(F.col(f"{p}words"), rules.window),
        f"{p}worded": F.filter(f"{p}lines", has_word),
    }).drop(f"{p}words")
    df = df.withColumns({
        f"{p}ordered": F.sort_array(f"{p}windows"),
        f"{p}n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
        f"{p}n_dup_lines": (F.size(f"{p}worded") - F.size(F.array_distinct(f"{p}worded"))).cast("long"),
        f"{p}failed": F.transform(f"{p}lines", lambda s: has_word(s) & line_fails(s, rules)),
    }).drop(f"{p}worded")
    repeats = _repeats(F.col(f"{p}ordered"))
    df = df.withColumns({
        f"{p}n_repeat_words": F.when(repeats, _covered(F.col(f"{p}windows"), rules.window)).otherwise(0).cast("long"),
        f"{p}n_failed_lines": F.size(F.filter(f"{p}failed", lambda x: x)).cast("long"),
        f"{p}cleaned": F.when(F.exists(f"{p}failed", lambda x: x), F.array_join(F.transform(
            F.filter(F.arrays_zip(F.col(f"{p}lines").alias("s"), F.col(f"{p}failed").alias("f")), lambda z: ~z["f"]), lambda z: z["s"]
        ), "\n")).otherwise(F.col(text)),
    }).drop(f"{p}windows", f"{p}ordered", f"{p}lines", f"{p}failed")
    left = F.when(F.col(f"{p}n_failed_lines") == 0, F.col(f"{p}word_chars")).otherwise(
        F.char_length(F.regexp_replace(f"{p}cleaned", WORD_GAP, ""))
    )
    failed = (F.col(f"{p}n_words") < rules.min_words) | (
        100 * F.col(f"{p}n_repeat_words") > rules.max_repeat_percent * F.col(f"{p}n_words")
    )
    loses = 100 * left < rules.min_kept_percent * F.col(f"{p}word_chars")
    return df.withColumns({f"{p}base_failed": failed, f"{p}kept": ~failed & ~loses})


def filter_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Documents that pass, with their failed lines removed and ``n_chars`` adjusted."""
    names = docs.columns
    p = free_prefix(names, "q_")
    # Behind the barrier the filter does not reach the judging, which would run a second time.
    out = once(judge(docs, rules, prefix=p), {f"{p}stays": F.col(f"{p}kept")}).where(f"{p}stays")
    new = {"text": F.col(f"{p}cleaned")}
    if "n_chars" in names:
        changed = F.when(F.col(f"{p}n_failed_lines") > 0, F.char_length(f"{p}cleaned")).otherwise(F.col("n_chars"))
        new["n_chars"] = changed.cast(docs.schema["n_chars"].dataType)
    return out.withColumns(new).select(*[F.col(f"`{n}`") for n in names])
