"""Quality rules whose thresholds follow each language and source.

Fixed rules (too few words, too many repeated words) come first. The others compare a document's ratios with fences
from the quartiles of its language and source: Q3 + SPREAD * (Q3 - Q1) + a least gap, and likewise below Q1. Quartiles
come from sketches: counts by value rounded to five significant bits, so sketches merge by adding counts, hold a bounded
number of buckets and are off by 1/16 at most. Sketches of small groups give way to those of the language, and of small
languages to that of all documents, merged from the same counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.storage import materialize

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
#: Fences reach this many interquartile ranges beyond the quartiles.
SPREAD = 3
#: Documents that a sketch must have seen to set a fence of its own.
MIN_SEEN = 50
#: Ratios in thousandths: least gap above Q3, and below Q1 (None: no lower fence).
RATIOS = {"symbols": (30, None), "dup_lines": (400, None), "repeats": (100, None), "word_length": (1500, 1500)}
#: Threshold tables up to this many groups are broadcast; larger ones are joined by a shuffle.
BROADCAST_GROUPS = 50_000
#: Low bits of a sorted window that are its place.
_POSITIONS = 26


def text_counts(text: Column) -> list[dict[str, Column]]:
    """Columns to add one dict after the other: counts of a text's words, symbols, lines and repeats."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    trimmed = F.btrim(whole, F.lit(" \t\n\x0b\f\r"))
    # Lines are compared as they are: the first and last keep their outer white space.
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Windows in order of their hash's high bits, with their place in the low ones: equal ones are neighbours, unless another
    # window with the same high bits stands between them. Texts where that can be, or that have more places, are put in order
    # by whole hashes, which takes more memory.
    limit = f"size(_q_grams) < {1 << _POSITIONS}L"
    high = F.expr(f"case when {limit} then transform(_q_grams, (x, i) -> (shiftleft(shiftright(x, {_POSITIONS}), {_POSITIONS}) | cast(i as bigint))) end")
    mask = f"{(1 << _POSITIONS) - 1}L"

    def near(y: str) -> str:
        return f"shiftright(x, {_POSITIONS}) = shiftright({y}, {_POSITIONS})"

    def same(y: str) -> str:
        return f"({near(y)} and get(_q_grams, cast(x & {mask} as int)) = get(_q_grams, cast({y} & {mask} as int)))"

    # Where all windows with a like neighbour also have an equal one, no other stands between equal ones.
    near_ones = F.expr(f"filter(_q_sorted, (x, j) -> coalesce({near('get(_q_sorted, j + 1)')}, false) or coalesce({near('get(_q_sorted, j - 1)')}, false))")
    equal_ones = F.expr(f"filter(_q_near, (x, j) -> coalesce({same('get(_q_near, j + 1)')}, false) or coalesce({same('get(_q_near, j - 1)')}, false))")
    placed = "sort_array(transform(_q_grams, (x, i) -> struct(x as h, i as p)))"
    whole = f"transform(array({placed}), s -> transform(filter(s, (x, j) -> coalesce(x.h = get(s, j + 1).h, false) or (j > 0 and x.h = get(s, j - 1).h)), x -> cast(x.p as bigint)))[0]"
    found = F.expr(f"sort_array(case when _q_sorted is null or size(_q_equal) < size(_q_near) then {whole} else transform(_q_equal, x -> x & {mask}) end)")
    covered = F.expr("aggregate(transform(_q_at, (p, j) -> least(3L, coalesce(get(_q_at, j + 1) - p, 3L))), 0L, (a, x) -> a + x)")
    return [
        {"_q_text": trimmed},
        {"_q_words": F.split("_q_text", SPACE), "_q_lines": lines, "_q_symbols": F.regexp_count("_q_text", F.lit(r"[#*$%&|<>]")).cast("long")},
        {
            "_q_n_words": F.when(F.col("_q_text") == "", 0).otherwise(F.size("_q_words")).cast("long"),
            "_q_chars": F.length(F.array_join("_q_words", "")).cast("long"),
            "_q_n_lines": F.size("_q_lines").cast("long"),
            "_q_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "_q_grams": F.expr("case when size(_q_words) < 3 then array() else transform(sequence(0, size(_q_words) - 3), i -> xxhash64(get(_q_words, i), get(_q_words, i + 1), get(_q_words, i + 2))) end"),
        },
        {"_q_sorted": F.sort_array(high)},
        {"_q_near": near_ones},
        {"_q_equal": equal_ones},
        {"_q_at": found},
        {"_q_repeats": covered},
    ]


_KEPT = ["_q_n_words", "_q_chars", "_q_n_lines", "_q_symbols", "_q_dup_lines", "_q_repeats"]


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """row (a struct of docs' columns, or those in keep), the counts (_q_ columns), ratios in thousandths, group keys and _q_base."""
    named = {k: F.coalesce(F.concat(F.lit("."), F.col(k).cast("string")), F.lit("")).alias(f"_q_{k}") for k in ("lang", "source")}
    columns = [F.col(f"`{c}`") for c in docs.columns if keep is None or c in keep]
    out = docs.select(F.struct(*columns).alias("row"), F.col("text").cast("string").alias("_q_raw"), *named.values())
    for more in text_counts(F.col("_q_raw")):
        out = out.withColumns(more)
    out = out.select("row", "_q_lang", "_q_source", *_KEPT)

    def ratio(part: str, whole: str) -> Column:
        return F.floor(1000 * F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("long")

    return out.withColumns({
        "_q_r_symbols": ratio("_q_symbols", "_q_chars"),
        "_q_r_dup_lines": ratio("_q_dup_lines", "_q_n_lines"),
        "_q_r_repeats": ratio("_q_repeats", "_q_n_words"),
        "_q_r_word_length": ratio("_q_chars", "_q_n_words"),
        "_q_base": (F.col("_q_n_words") < MIN_WORDS) | (100 * F.col("_q_repeats") > 50 * F.col("_q_n_words")),
    })


def rounded(value: Column) -> Column:
    """Down to five significant bits; values below 64 as they are. Exact in integers."""
    drop = F.length(F.bin(value)) - 5
    return F.when(value < 64, value).otherwise(F.expr("0L") + F.floor(value / F.pow(F.lit(2), drop)).cast("long") * F.pow(F.lit(2), drop).cast("long"))


def sketches(rows: DataFrame) -> DataFrame:
    """Counts by language, source, ratio and rounded value over documents that pass the fixed rules."""
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("ratio"), F.col(f"_q_r_{k}").alias("value")) for k in RATIOS)))
    flat = rows.filter(~F.col("_q_base")).select("_q_lang", "_q_source", values.alias("v")).select("_q_lang", "_q_source", "v.ratio", rounded(F.col("v.value")).alias("bucket"))
    return flat.groupBy("_q_lang", "_q_source", "ratio", "bucket").agg(F.count("*").alias("n"))


def _quartiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    merged = counts.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "ratio").orderBy("bucket"))
    seen = F.sum("n").over(Window.partitionBy(*keys, "ratio"))
    ranked = merged.withColumns({"upto": upto, "seen": seen})
    return ranked.groupBy(*keys, "ratio").agg(*(F.min(F.when(4 * F.col("upto") >= q * F.col("seen"), F.col("bucket"))).alias(f"q{q}") for q in (1, 3)), F.max("seen").alias("seen"))


def fences(counts: DataFrame) -> DataFrame:
    """low_ and high_ of each ratio by language and source."""
    every = _quartiles(counts, []).select("ratio", *(F.col(c).alias(f"{c}_all") for c in ("q1", "q3")))
    lang = _quartiles(counts, ["_q_lang"]).select("_q_lang", "ratio", *(F.col(c).alias(f"{c}_lang") for c in ("q1", "q3", "seen")))
    rows = _quartiles(counts, ["_q_lang", "_q_source"]).join(lang, ["_q_lang", "ratio"]).join(every, "ratio")

    def chosen(q: str) -> Column:
        return F.when(F.col("seen") >= MIN_SEEN, F.col(q)).when(F.col("seen_lang") >= MIN_SEEN, F.col(f"{q}_lang")).otherwise(F.col(f"{q}_all"))

    rows = rows.select("_q_lang", "_q_source", "ratio", chosen("q1").alias("q1"), chosen("q3").alias("q3"))
    sides = []
    for k, (above, below) in RATIOS.items():
        spread = SPREAD * (F.col("q3") - F.col("q1"))
        sides.append(F.max(F.when(F.col("ratio") == k, F.col("q3") + spread + above)).alias(f"_q_high_{k}"))
        if below is not None:
            sides.append(F.max(F.when(F.col("ratio") == k, F.col("q1") - spread - below)).alias(f"_q_low_{k}"))
    return rows.groupBy("_q_lang", "_q_source").agg(*sides)


def judged(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """row (docs' columns, or those in keep, as a struct), the counts, _q_base (a fixed rule failed) and _q_kept.

    docs needs text, lang and source; other columns may have any names. Null texts have no words and fail; null languages
    and sources are groups of their own. Every row is judged, so repeated rows get the same verdict. An empty table gives
    an empty result.
    """
    rows = materialize(measured(docs, keep), "quality-rows")
    limits = materialize(fences(sketches(rows)), "quality-fences")
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    kept = ~F.col("_q_base")
    for k, (_, below) in RATIOS.items():
        kept = kept & F.coalesce(F.col(f"_q_r_{k}") <= F.col(f"_q_high_{k}"), F.lit(False))
        if below is not None:
            kept = kept & F.coalesce(F.col(f"_q_r_{k}") >= F.col(f"_q_low_{k}"), F.lit(False))
    return rows.join(limits, ["_q_lang", "_q_source"], "left").select("row", *_KEPT, "_q_base", kept.alias("_q_kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that the rules keep."""
    return judged(docs).filter("_q_kept").select("row.*")
