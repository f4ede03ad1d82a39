"""Queries on documents and pages: counts, grades, signals and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.text import sentences, text_of, tokens, word_chunks
from papyrine.operators import evaluation, textstats
from papyrine.tables import table

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LETTERS = "regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')"
_SEARCH = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_+#.-]+')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


QUERIES = {
    "token_stats": lambda s, d: textstats.token_stats(docs(s, d)),
    "word_count_bands": lambda s, d: textstats.word_count_bands(docs(s, d)),
    "flesch_kincaid": lambda s, d: textstats.flesch_kincaid(docs(s, d)),
    "sentence_complexity_score": lambda s, d: textstats.sentence_complexity(docs(s, d)),
    "text_extractability": lambda s, d: textstats.text_extractability(docs(s, d)),
    "glyph_scan": lambda s, d: textstats.glyph_scan(docs(s, d)),
    "doc_signal_hits": lambda s, d: textstats.signal_hits(docs(s, d)),
    "page_signal_hits": lambda s, d: textstats.signal_hits(table(s, d, "pages").withColumnRenamed("html", "text")),
    "passive_rate_by_lang": lambda s, d: textstats.passive_rate(docs(s, d)),
    "domain_terms_topk": lambda s, d: textstats.domain_terms(docs(s, d)),
}


def placeholder_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filler lexicon is derived: the letter tokens of the benchmark passages that begin with th."""
    passages = table(spark, sf_dir, "benchmark").select(F.explode(F.transform(tokens(F.col("text"), "letters"), F.lower)).alias("word"))
    return textstats.placeholder_ratio(docs(spark, sf_dir), passages.filter(F.col("word").startswith("th")).distinct())


def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = docs(spark, sf_dir).select("doc_id", F.posexplode(word_chunks(F.col("text"), 180, 40)).alias("chunk", "words"))
    return chunks.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("words").cast("long").alias("n_chars"), F.md5("words").alias("words_md5"))


def sentence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = docs(spark, sf_dir).select("lang", F.explode(sentences(F.col("text"))).alias("s"))
    return parts.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.length("s")), 6).alias("mean_chars"), F.max(F.length("s")).cast("long").alias("longest"))


def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = docs(spark, sf_dir).select("doc_id", F.md5(text_of(F.col("text"))).alias("text_md5"))
    return keyed.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


def keep_first_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 25 documents of each source after global deduplication."""
    first = exact_dedupe(spark, sf_dir).select("doc_id").join(docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return evaluation.at_most(first, ["source"], ["doc_id"], 25).select("source", "doc_id", "rank")


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = evaluation.group_split(docs(spark, sf_dir).select("doc_id"), "doc_id")
    return split.select("doc_id", "split")


QUERIES |= {
    "placeholder_ratio": placeholder_ratio,
    "chunk_words": chunk_words,
    "sentence_lengths": sentence_lengths,
    "exact_dedupe": exact_dedupe,
    "keep_first_by_source": keep_first_by_source,
    "group_split_md5": group_split,
}

_FK = r"""
WITH parts AS (
  SELECT doc_id, source, {letters} AS w,
    len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?;]+'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: length(s) > 5)) AS n_sentences
  FROM documents),
counted AS (
  SELECT doc_id, source, n_sentences, len(w) AS n_letter_words,
    coalesce(list_sum(list_transform(w, lambda x: CASE WHEN length(x) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(
      CASE WHEN lower(x) LIKE '%e' AND NOT regexp_matches(lower(x), '[^aeiouy]le$') THEN left(lower(x), length(x) - 1) ELSE lower(x) END, '[aeiouy]+'))) END)), 0)::BIGINT AS n_syllables
  FROM parts),
graded AS (
  SELECT *, CASE WHEN n_letter_words > 0 AND n_sentences > 0
    THEN greatest(0.0::DOUBLE, 0.39::DOUBLE * (n_letter_words / n_sentences) + 11.8::DOUBLE * (n_syllables / n_letter_words) - 15.59::DOUBLE) ELSE 0.0::DOUBLE END AS fk
  FROM counted)
""".replace("{letters}", _LETTERS)


def _signals(name: str, column: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{k}' AS signal, count(*) AS n_docs FROM {name} WHERE regexp_matches(coalesce({column}, ''), '{p}')" for k, p in textstats.SIGNALS.items())
    return f"SELECT * FROM ({parts}) WHERE n_docs > 0"


SQL = {
    "token_stats": f"""
SELECT doc_id, len({_WORDS})::BIGINT AS n_words, len({_LETTERS})::BIGINT AS n_letter_tokens, len({_SEARCH})::BIGINT AS n_search_tokens,
  len(list_distinct({_SEARCH}))::BIGINT AS n_distinct, length(coalesce(text, ''))::BIGINT AS n_characters FROM documents""",
    "word_count_bands": f"""
SELECT lang, CASE WHEN n < 50 THEN 'under 50' WHEN n < 100 THEN 'under 100' WHEN n < 500 THEN 'under 500' WHEN n < 2000 THEN 'under 2000' ELSE '2000 and more' END AS band,
  count(*) AS n_docs FROM (SELECT lang, len({_WORDS}) AS n FROM documents) GROUP BY 1, 2""",
    "flesch_kincaid": _FK + "SELECT doc_id, n_sentences::BIGINT AS n_sentences, n_letter_words::BIGINT AS n_letter_words, n_syllables, round(fk, 6) AS fk_grade FROM graded",
    "sentence_complexity_score": _FK + """, scored AS (
  SELECT source, CASE WHEN fk BETWEEN 8 AND 12 THEN 1.0 WHEN fk BETWEEN 6 AND 14 THEN 0.7 ELSE 0.4 END::DOUBLE AS g,
    CASE WHEN per BETWEEN 10 AND 25 THEN 1.0 WHEN per BETWEEN 7 AND 35 THEN 0.7 ELSE 0.4 END::DOUBLE AS w
  FROM (SELECT *, n_letter_words / greatest(n_sentences, 1) AS per FROM graded))
SELECT source, count(*) AS n_docs, round(avg(15 * (0.5 * g + 0.5 * w)), 6) AS score FROM scored GROUP BY source""",
    "text_extractability": f"""
SELECT doc_id, round(CASE WHEN length(trim(t)) < 50 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 20 * (1 -
  (CASE WHEN len(regexp_extract_all(t, '[\\x{{FFFD}}\\x{{10000}}-\\x{{10FFFF}}]')) / greatest(length(t), 1) > 0.05 THEN 0.5 ELSE 0.0 END::DOUBLE
   + CASE WHEN n < 100 THEN 0.3 ELSE 0.0 END::DOUBLE + CASE WHEN n < 50 THEN 0.2 ELSE 0.0 END::DOUBLE))) END, 1) AS score
FROM (SELECT doc_id, coalesce(text, '') AS t, len({_WORDS}) AS n FROM documents)""",
    "glyph_scan": r"""
SELECT unicode(glyph)::BIGINT AS code_point, CASE WHEN unicode(glyph) BETWEEN 64256 AND 64262 THEN 'ligature' WHEN unicode(glyph) = 65533 THEN 'replacement'
  WHEN unicode(glyph) BETWEEN 57344 AND 63743 THEN 'private use' ELSE 'other' END AS kind, count(*)::BIGINT AS n, count(DISTINCT doc_id) AS n_docs
FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x7F]')) AS glyph FROM documents) GROUP BY glyph""",
    "doc_signal_hits": _signals("documents", "text"),
    "page_signal_hits": _signals("pages", "html"),
    "passive_rate_by_lang": f"""
SELECT lang, round(avg((hits > 0)::INT::DOUBLE), 6) AS share, round(1000 * sum(hits) / greatest(sum(n), 1), 6) AS per_1000
FROM (SELECT lang, len(regexp_extract_all(coalesce(text, ''), '{textstats.SIGNALS["passive"]}')) AS hits, len({_WORDS}) AS n FROM documents) GROUP BY lang""",
    "domain_terms_topk": """
WITH terms AS (
  SELECT source, lower(t) AS term, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9_.+-]+')) AS t FROM documents)
  WHERE length(t) > 3 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rank FROM terms)
SELECT source, term, n, rank FROM ranked WHERE rank <= 10 AND n >= 2""",
    "placeholder_ratio": f"""
WITH filler AS (
  SELECT DISTINCT lower(w) AS word FROM (SELECT unnest({_LETTERS}) AS w FROM benchmark) WHERE starts_with(lower(w), 'th')),
words AS (SELECT doc_id, lower(w) AS word FROM (SELECT doc_id, unnest({_LETTERS}) AS w FROM documents)),
shares AS (SELECT doc_id, round(count(f.word) / count(*), 6) AS ratio FROM words LEFT JOIN filler f USING (word) GROUP BY doc_id)
SELECT doc_id, ratio, ratio >= 0.05 AS flagged FROM shares""",
    "chunk_words": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (
  SELECT doc_id, w, CASE WHEN len(w) = 0 THEN []::BIGINT[] WHEN len(w) <= 180 THEN [0] ELSE range(0, len(w) - 40, 140) END AS s FROM w),
placed AS (SELECT doc_id, w, unnest(s) AS a, unnest(range(0, len(s))) AS chunk FROM starts)
SELECT doc_id, chunk, length(c)::BIGINT AS n_chars, md5(c) AS words_md5 FROM (SELECT doc_id, chunk, array_to_string(w[a+1:a+180], ' ') AS c FROM placed)""",
    "sentence_lengths": """
WITH parts AS (SELECT lang, trim(unnest(regexp_split_to_array(coalesce(text, ''), '[.!?;]+')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM documents)
SELECT lang, count(*) AS n, round(avg(length(s)), 6) AS mean_chars, max(length(s)) AS longest FROM parts WHERE length(s) > 5 GROUP BY lang""",
    "exact_dedupe": "SELECT md5(coalesce(text, '')) AS text_md5, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1",
    "keep_first_by_source": """
WITH first AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(coalesce(text, ''))),
ranked AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM first JOIN documents USING (doc_id))
SELECT source, doc_id, rank FROM ranked WHERE rank <= 25""",
    "group_split_md5": """
SELECT doc_id, CASE WHEN p < 5 THEN 'test' WHEN p < 10 THEN 'val' ELSE 'train' END AS split
FROM (SELECT doc_id, ('0x' || md5(doc_id::VARCHAR))::UHUGEINT % 100 AS p FROM documents)""",
}
