"""Statistics of texts: counts, readability grades, glyphs, signals and placeholders. One row per document and finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import looked, sentences, syllables, text_of, tokens, words

#: Signals by name: patterns that both Java and RE2 read alike.
SIGNALS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "percent": r"[0-9]+(\.[0-9]+)?[ ]?%",
    "ipv4": r"(^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}([^0-9.]|$)",
    "phone": r"\+?[0-9(][0-9 ().-]{8,}[0-9]",
    "license": r"(?i)licen[sc]e",
    "url": r"https?://[A-Za-z0-9.-]+",
    "year": r"(^|[^0-9])(19|20)[0-9]{2}([^0-9]|$)",
    "todo": r"(^|[^A-Za-z0-9_])(TODO|TBD|FIXME|INSERT HERE|REPLACE THIS)([^A-Za-z0-9_]|$)",
    "masked_metric": r"(^|[^A-Za-z0-9_])(XX%|\$XX|XX|[0-9]+[Xx])([^A-Za-z0-9_]|$)",
    "bracketed": r"\[(Company ?Name|Your ?Name|Job ?Title|Insert [^\]]*|City|State|Degree|University|Date)\]",
    "passive": r"(?i)(^|[^A-Za-z0-9_])(was|were|been|being|is|are)[ ][A-Za-z0-9_]+ed([^A-Za-z0-9_]|$)",
    "first_person": r"(^|[^A-Za-z0-9_])(I|me|my|mine)([^A-Za-z0-9_]|$)",
}


def token_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the number of words, letter tokens, search tokens, distinct search tokens and characters."""
    search = tokens(F.col("text"), "search")
    return docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.size(tokens(F.col("text"), "letters")).cast("long").alias("n_letter_tokens"), F.size(search).cast("long").alias("n_search_tokens"), F.size(F.array_distinct(search)).cast("long").alias("n_distinct"), F.length(text_of(F.col("text"))).cast("long").alias("n_characters"))


def word_count_bands(docs: DataFrame) -> DataFrame:
    """Documents by language and band of word counts."""
    n = F.size(words(F.col("text")))
    band = F.when(n < 50, "under 50").when(n < 100, "under 100").when(n < 500, "under 500").when(n < 2000, "under 2000").otherwise("2000 and more")
    return docs.select("lang", band.alias("band")).groupBy("lang", "band").agg(F.count("*").alias("n_docs"))


def readability_inputs(docs: DataFrame, *keep: str) -> DataFrame:
    """Sentences, letter tokens and syllables of each row."""
    letters = tokens(F.col("text"), "letters")
    total = F.aggregate(F.transform("_letters", syllables), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = docs.select(*keep, letters.alias("_letters"), F.size(sentences(F.col("text"))).cast("long").alias("n_sentences"))
    return rows.select(*keep, "n_sentences", F.size("_letters").cast("long").alias("n_letter_words"), total.alias("n_syllables"))


def grade(words_: Column, sentences_: Column, syllables_: Column) -> Column:
    """Flesch-Kincaid grade, at least 0; 0 without words or sentences."""
    value = 0.39 * (words_ / F.greatest(sentences_, F.lit(1))) + 11.8 * (syllables_ / F.greatest(words_, F.lit(1))) - 15.59
    return F.when((words_ > 0) & (sentences_ > 0), F.greatest(value, F.lit(0.0))).otherwise(0.0)


def flesch_kincaid(docs: DataFrame) -> DataFrame:
    rows = readability_inputs(docs, "doc_id")
    return rows.select("*", F.round(grade(F.col("n_letter_words"), F.col("n_sentences"), F.col("n_syllables")), 6).alias("fk_grade"))


def sentence_complexity(docs: DataFrame) -> DataFrame:
    """By source: the score out of 15 for grades within 8 to 12 and 10 to 25 words a sentence, averaged over documents."""
    rows = readability_inputs(docs, "source").withColumn("fk", grade(F.col("n_letter_words"), F.col("n_sentences"), F.col("n_syllables")))
    rows = rows.withColumn("per", F.col("n_letter_words") / F.greatest(F.col("n_sentences"), F.lit(1)))
    by_grade = F.when(F.col("fk").between(8, 12), 1.0).when(F.col("fk").between(6, 14), 0.7).otherwise(0.4)
    by_words = F.when(F.col("per").between(10, 25), 1.0).when(F.col("per").between(7, 35), 0.7).otherwise(0.4)
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.round(F.avg(15 * (0.5 * by_grade + 0.5 * by_words)), 6).alias("score"))


def text_extractability(docs: DataFrame, most: float = 20.0) -> DataFrame:
    """Score of how much text could be read: 0 below 50 characters, less for replacement characters and few words."""
    text = text_of(F.col("text"))
    n = F.size(words(F.col("text")))
    garbled = F.regexp_count(text, F.lit("[�\U00010000-\U0010ffff]")) / F.greatest(F.length(text), F.lit(1))
    lost = F.when(garbled > 0.05, 0.5).otherwise(0.0) + F.when(n < 100, 0.3).otherwise(0.0) + F.when(n < 50, 0.2).otherwise(0.0)
    score = F.when(F.length(F.btrim(text)) < 50, 0.0).otherwise(F.greatest(F.lit(0.0), most * (1 - lost)))
    return docs.select("doc_id", F.round(score, 1).alias("score"))


def glyph_scan(docs: DataFrame) -> DataFrame:
    """Non-ASCII characters by code point: how many, in how many documents."""
    chars = docs.select("doc_id", F.explode(F.regexp_extract_all(text_of(F.col("text")), F.lit("[^\\x00-\\x7F]"), F.lit(0))).alias("glyph"))
    counts = chars.groupBy("glyph", "doc_id").agg(F.count("*").alias("n"))
    code = F.ascii("glyph")
    kind = F.when(code.between(0xFB00, 0xFB06), "ligature").when(code == 0xFFFD, "replacement").when(code.between(0xE000, 0xF8FF), "private use").otherwise("other")
    return counts.groupBy("glyph").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs")).select(code.cast("long").alias("code_point"), kind.alias("kind"), "n", "n_docs")


def has_signal(text: Column, pattern: str) -> Column:
    """Whether a pattern of SIGNALS is in the text; one with an @ is looked for only where there is one."""
    found = text.rlike(looked(pattern))
    return F.contains(text, F.lit("@")) & found if pattern == SIGNALS["email"] else found


def signal_hits(docs: DataFrame, signals: dict[str, str] = SIGNALS) -> DataFrame:
    """Documents by signal, from one pass over the texts."""
    found = F.array(*(F.when(has_signal(text_of(F.col("text")), p), F.lit(k)) for k, p in signals.items()))
    return docs.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("signal")).groupBy("signal").agg(F.count("*").alias("n_docs"))


def passive_rate(docs: DataFrame) -> DataFrame:
    """By language, the share of documents with a passive phrase and phrases per 1000 words."""
    hits = F.regexp_count(text_of(F.col("text")), F.lit(SIGNALS["passive"]))
    rows = docs.select("lang", hits.alias("hits"), F.size(words(F.col("text"))).alias("n"))
    return rows.groupBy("lang").agg(F.round(F.avg((F.col("hits") > 0).cast("double")), 6).alias("share"), F.round(1000 * F.sum("hits") / F.greatest(F.sum("n"), F.lit(1)), 6).alias("per_1000"))


def placeholder_ratio(docs: DataFrame, filler: DataFrame, least: float = 0.05) -> DataFrame:
    """doc_id, share of letter tokens that are in filler.word, and whether it is least or more. filler comes as a table of any size."""
    rows = docs.select("doc_id", F.explode(F.transform(tokens(F.col("text"), "letters"), F.lower)).alias("word"))
    marked = rows.groupBy("doc_id", "word").agg(F.count("*").alias("n")).join(filler.select("word").distinct().withColumn("hit", F.lit(1)), "word", "left")
    share = F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)) / F.sum("n")
    return marked.groupBy("doc_id").agg(F.round(share, 6).alias("ratio")).withColumn("flagged", F.col("ratio") >= least)


def domain_terms(docs: DataFrame, top: int = 10, candidates: int = 20) -> DataFrame:
    """By source, the most frequent long terms: of the first candidates by count those with two or more, the first top."""
    from pyspark.sql import Window

    terms = docs.select("source", F.explode(F.transform(tokens(F.col("text"), "domain"), F.lower)).alias("term")).filter(F.length("term") > 3)
    counts = terms.groupBy("source", "term").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n").desc(), "term"))).filter(F.col("rank") <= candidates)
    return ranked.filter((F.col("n") >= 2) & (F.col("rank") <= top)).select("source", "term", "n", F.col("rank").cast("long").alias("rank"))
