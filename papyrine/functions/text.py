"""Tokenisers, counts and grades of text as Column expressions. Patterns use ASCII classes, so other engines agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokenisers by what uses them. Each is observable behaviour, so they stay apart.
TOKENS = {
    "search": r"[a-z0-9_+#.-]+",
    "grading": r"[A-Za-z0-9][A-Za-z0-9_.+#×%-]*",
    "letters": r"[A-Za-z]+",
    "evidence": r"[a-z][a-z0-9+#.-]{2,}",
    "anchor": r"[a-z0-9][a-z0-9+#.%-]*",
    "words": r"[A-Za-z0-9_]+",
    "long_words": r"[a-z]{4,}",
    "domain": r"[A-Za-z][A-Za-z0-9_.+-]+",
    "manifest": r"[@A-Za-z0-9][A-Za-z0-9_./@-]*",
}
_LOWERED = {"search", "evidence", "anchor", "long_words"}
#: Words left out of search.
SEARCH_STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


def looked(pattern: str) -> str:
    """A pattern that is found in the same texts: word edges are looked at, where the pattern matches the characters beside them.

    Java finds it several times as fast. Where matches are counted or cut out it isn't the same.
    """
    return pattern.replace(r"(^|[^A-Za-z0-9_])", r"(?<![A-Za-z0-9_])").replace(r"([^A-Za-z0-9_]|$)", r"(?![A-Za-z0-9_])")


def text_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def tokens(column: Column, kind: str) -> Column:
    text = text_of(column)
    return F.regexp_extract_all(F.lower(text) if kind in _LOWERED else text, F.lit(TOKENS[kind]), F.lit(0))


def search_tokens(column: Column, stop: list[str] = SEARCH_STOP) -> Column:
    """Tokens for retrieval. Repeats stay: term frequencies need them."""
    return F.filter(tokens(column, "search"), lambda t: ~t.isin(stop))


def words(column: Column) -> Column:
    return F.regexp_extract_all(text_of(column), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def syllables(word: Column) -> Column:
    """Vowel groups, at least one; a final e is silent unless it follows a consonant and l. Up to three letters count one."""
    w = F.lower(word)
    silent = w.endswith("e") & ~w.rlike("[^aeiouy]le$")
    stem = F.when(silent, F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(F.regexp_count(stem, F.lit("[aeiouy]+")), F.lit(1))).cast("long")


def sentences(column: Column) -> Column:
    """Stripped parts between runs of . ! ? ; that have more than five characters."""
    parts = F.transform(F.split(text_of(column), "[.!?;]+"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r")))
    return F.filter(parts, lambda s: F.length(s) > 5)


def group_percent(column: Column) -> Column:
    """md5 of the text, taken as a 128-bit number, modulo 100."""
    h = F.md5(column)

    def half(start: int) -> Column:
        return F.conv(F.substring(h, start, 16), 16, 10).cast("decimal(20,0)") % 100

    return ((half(1) * 16 + half(17)) % 100).cast("int")


def word_chunks(column: Column, size: int, overlap: int) -> Column:
    """Array of chunks of size words that overlap; one chunk if there are no more words than that, none without words."""
    step = size - overlap
    w = words(column)
    starts = F.when(F.size(w) == 0, F.array().cast("array<int>")).when(F.size(w) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(w) - overlap - 1, F.lit(step)))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))
