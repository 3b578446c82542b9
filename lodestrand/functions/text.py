"""Text expressions. All are built-in column expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "[\\x{4e00}-\\x{9fff}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pairs_in_row(items: Column) -> Column:
    """Neighbouring elements of an array, joined; empty for fewer than two."""
    return bound(items, lambda h: F.when(F.size(h) >= 2, F.zip_with(F.slice(h, F.lit(1), F.size(h) - 1), F.slice(h, F.lit(2), F.size(h) - 1), lambda x, y: F.concat(x, y))).otherwise(F.array().cast("array<string>")))


def latin_runs(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+"), F.lit(0))


def han_chars(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(HAN), F.lit(0))


def mixed_tokens(text: Column | str) -> Column:
    """Latin runs, Han characters, and bigrams of the sequence of Han characters (they bridge what stands between),
    repeats kept."""
    return bound(han_chars(text), lambda han: F.concat(latin_runs(text), han, pairs_in_row(han)))


def token_set(text: Column | str) -> Column:
    return F.array_distinct(mixed_tokens(text))


def quality_tokens(text: Column | str) -> Column:
    """Han trigrams and words of the text without any white space, each once, in order of first appearance."""
    return bound(F.regexp_replace(F.lower(_c(text)), "(?U)\\s+", ""), _quality)


def _quality(whole: Column) -> Column:
    runs = F.regexp_extract_all(whole, F.lit(HAN + "{3,}"), F.lit(0))
    grams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 2), lambda i: F.substring(r, i, F.lit(3)))))
    return F.array_distinct(F.concat(grams, F.regexp_extract_all(whole, F.lit("[a-z][a-z0-9_+#.-]{1,}"), F.lit(0))))


def corpus_text(text: Column | str) -> Column:
    """Lines with single blanks, runs of empty lines as one, no white space at the ends."""
    lines = F.transform(F.split(F.replace(_c(text), F.lit("\x00"), F.lit("")), "\\R"), lambda x: F.trim(F.regexp_replace(x, "(?U)\\s+", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def match_text(text: Column | str) -> Column:
    """Lower case without white space, for containment tests."""
    return F.lower(F.regexp_replace(_c(text), "(?U)\\s+", ""))


def squeezed(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), "(?U)\\s+", " "))


def snippet(text: Column | str, n: int = 220) -> Column:
    flat = squeezed(text)
    return F.concat(F.substring(flat, 1, n), F.when(F.length(flat) > n, "...").otherwise(""))


def token_estimate(text: Column | str) -> Column:
    """How many Han characters, Latin words, numbers and other signs a text has."""
    return F.size(F.regexp_extract_all(_c(text), F.lit(f"(?U){HAN}|[A-Za-z]+|\\d+|[^\\s]"), F.lit(0)))


def char_bigrams(text: Column | str) -> Column:
    return bound(match_text(text), lambda t: F.array_distinct(F.when(F.length(t) >= 2, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def overlap(query: Column, document: Column) -> Column:
    """Share of the query's tokens that the document has; 0 for an empty query."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, document)) / F.size(query))


def contains_any(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def short_id(*parts: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(F.concat(*parts)), 1, n)


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.greatest(a, b)
