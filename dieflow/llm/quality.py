"""Quality rules: one threshold table compiled into one Spark projection.

Every measure is a built-in expression over the whole text, so the operator is
a narrow map: no shuffle, no Python, nothing kept between rows.  Repeats of
8-word windows are found by sorting the window hashes (64 bits) of the one
text, which costs n log n in its words; texts without a repeat skip the sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dieflow.llm.common import let

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

#: Frequent function words, by language.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "on", "with", "as", "was", "be", "by", "are", "this", "or", "at", "from", "an", "have", "not"),
    "de": ("der", "die", "das", "und", "in", "zu", "den", "von", "mit", "ist", "im", "des", "für", "auf", "nicht", "ein", "eine", "dem", "als", "auch", "es", "an", "sich", "wie"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "est", "que", "qui", "dans", "pour", "par", "sur", "au", "avec", "pas", "ce", "il", "plus", "aux"),
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "para", "del", "se", "es", "no", "su", "al", "lo", "como", "más", "o", "a"),
}


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= measure / per <= high; a zero denominator passes."""

    name: str
    measure: str
    per: str
    low: float = 0.0
    high: float = float("inf")


#: The threshold table.
RULES: tuple[Rule, ...] = (
    Rule("word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("shouting", "n_marks", "n_words", high=0.3),
    Rule("capitals", "n_capitals", "word_chars", high=0.4),
    Rule("letters", "n_letters", "word_chars", low=0.5),
    Rule("stop_words", "n_stop_words", "n_words", low=0.03),
    Rule("stutter", "n_stutters", "n_words", high=0.2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.3),
)


def _repeated_words(words: Column) -> Column:
    """Words that lie in an 8-word window found twice or more."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(starts: Column) -> Column:
        # Sorted starts: each adds the words up to the next start, at most a window.
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")), lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["at"])).alias("n"), i.alias("at")), lambda s: s["n"])

    def from_sorted(s: Column) -> Column:
        hits = F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]))
        return covered(F.sort_array(F.transform(hits, lambda e: e["i"])))

    def from_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, from_sorted))

    return F.when(n < WINDOW, F.lit(0)).otherwise(let(hashes, from_hashes))


def measures(text: Column, stop_words: Mapping[str, Sequence[str]] = STOP_WORDS) -> Column:
    """A struct of longs with every measure that rules may name; null counts as the empty text."""
    given = F.coalesce(text.cast("string"), F.lit(""))
    stops = F.array(*(F.lit(w) for w in sorted({w for ws in stop_words.values() for w in ws})))

    def of_lines(lines: Column) -> dict[str, Column]:
        return {
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•·]"))),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))),
        }

    def of_words(words: Column, t: Column) -> dict[str, Column]:
        return {
            "n_words": F.size(words),
            "word_chars": F.char_length(F.array_join(words, "")),
            "n_repeat_words": _repeated_words(words),
            "n_stutters": F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))),
            # A stop word is short: longer words skip the list.
            "n_stop_words": F.size(F.filter(words, lambda w: (F.octet_length(w) < 8) & F.array_contains(stops, F.lower(w)))),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)),
            "n_marks": F.regexp_count(t, F.lit("[!?]")),
            "n_capitals": F.regexp_count(t, F.lit(r"\p{Lu}")),
            "n_letters": F.regexp_count(t, F.lit(r"\p{L}")),
        }

    def longs(columns: dict[str, Column]) -> list[Column]:
        return [c.cast("long").alias(n) for n, c in columns.items()]

    def both(t: Column) -> Column:
        words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(words, lambda w: let(lines, lambda x: F.struct(*longs(of_words(w, t)), *longs(of_lines(x)))))

    return let(given, both)


def verdict(m: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Whether a measures struct passes every rule of the table."""
    passed = F.lit(True)
    for r in rules:
        ratio = m[r.measure] / F.when(m[r.per] > 0, m[r.per])
        passed = passed & F.coalesce((ratio >= r.low) & (ratio <= r.high), F.lit(True))
    return passed


def base_failed(m: Column) -> Column:
    """Under 20 words, or over 30 % of them in repeated windows."""
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def quality(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs plus a struct column `quality`: the measures, base_failed and kept.

    Null and empty texts have no words and fail the base.  Every row stays,
    repeated ones too; an existing column named quality is replaced.
    """
    measured = docs.withColumn("quality", measures(F.col(text)))
    m = F.col("quality")
    failed = base_failed(m)
    return measured.withColumn("quality", m.withField("base_failed", failed).withField("kept", ~failed & verdict(m, rules)))
