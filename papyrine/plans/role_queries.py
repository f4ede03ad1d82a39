"""Queries on roles: families of terms from passages, documents as profiles with fields, levels of customers' posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.text import text_of
from papyrine.operators import roles
from papyrine.plans import timeline_queries
from papyrine.tables import table

#: Passages fall into so many families; their words of six letters or more that no other family has are its keywords.
FAMILIES = 6
FIELDS = {"title": 3.0, "body": 1.0}


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select((F.col("item_id") % FAMILIES).alias("place"), F.explode(F.regexp_extract_all(F.lower(text_of(F.col("text"))), F.lit("[a-z0-9_+#]+"), F.lit(0))).alias("keyword"))
    own = words.filter("length(keyword) >= 6").groupBy("keyword").agg(F.min("place").alias("place"), F.max("place").alias("other")).filter("place = other")
    return own.select(F.concat(F.lit("family "), F.col("place").cast("string")).alias("family"), "keyword", "place")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line as summary, the first words of later lines as titles, later lines as statements, capitals as skills; the text as raw."""
    text = text_of(F.col("text"))
    lines = F.split(text, "\n")
    later = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    parts = {"summary": F.get(lines, F.lit(0)), "titles": F.array_join(F.transform(later, lambda x: F.regexp_extract(x, r"^(?:\S+\s+){0,3}\S*", 0)), " "), "statements": F.array_join(later, " "), "skills": F.array_join(F.regexp_extract_all(text, F.lit("[A-Z][a-z]+"), F.lit(0)), " "), "raw": text}
    rows = F.array(*(F.struct(F.lit(k).alias("field"), v.alias("text")) for k, v in parts.items()))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*")


def document_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.inferred_roles(table(spark, sf_dir, "documents"), _fields(spark, sf_dir), _families(spark, sf_dir))


def ranked_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three passages that fit a document's first line best; a passage's first five words are its title."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("role"), F.regexp_replace(text_of(F.col("text")), r"[\x20\x09-\x0D]+", " ").alias("t"))
    title = F.regexp_extract("t", r"^(?:[^ ]+ ){0,5}", 0)
    held = F.array(F.struct(F.lit("title").alias("field"), title.alias("text")), F.struct(F.lit("body").alias("field"), F.substring("t", F.length(title) + 1, F.length("t")).alias("text")))
    profiles = table(spark, sf_dir, "documents").select("doc_id", F.get(F.split(text_of(F.col("text")), "\n"), F.lit(0)).alias("text"))
    return roles.ranked_roles(profiles, items.select("role", F.explode(held).alias("x")).select("role", "x.*"), FIELDS)


QUERIES = {
    "document_roles": document_roles,
    "ranked_roles": ranked_roles,
    "owner_levels": lambda s, d: roles.levels(timeline_queries._dated(s, d), timeline_queries.NOW),
}

_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9_+#]+')"
_LINE = "coalesce(string_split(coalesce(text, ''), chr(10))[1], '')"
SQL = {
    "document_roles": f"""
WITH words AS (SELECT item_id % {FAMILIES} AS place, unnest({_TOKENS.format("coalesce(text, '')")}) AS keyword FROM benchmark),
families AS (SELECT keyword, min(place) AS place FROM words WHERE length(keyword) >= 6 GROUP BY keyword HAVING min(place) = max(place)),
split AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
fields AS (
  SELECT doc_id, 3 AS w, 0 AS raw, l[1] AS f FROM split
  UNION ALL SELECT doc_id, 3, 0, array_to_string(list_transform(l[2:], lambda x: regexp_extract(x, '^(?:\\S+\\s+){{0,3}}\\S*')), ' ') FROM split
  UNION ALL SELECT doc_id, 2, 0, array_to_string(l[2:], ' ') FROM split UNION ALL SELECT doc_id, 1, 0, array_to_string(regexp_extract_all(t, '[A-Z][a-z]+'), ' ') FROM split
  UNION ALL SELECT doc_id, 0, 1, t FROM split),
found AS (SELECT doc_id, w, raw, unnest({_TOKENS.format("f")}) AS keyword FROM fields),
scores AS (SELECT doc_id, place, sum(w)::BIGINT AS score, sum(raw)::BIGINT AS raw FROM found JOIN families USING (keyword) GROUP BY doc_id, place),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC, place) AS b FROM scores),
best AS (SELECT doc_id, max(score) AS score, max(raw) AS raw, max(place) FILTER (a = 1) AS pa, max(place) FILTER (b = 1) AS pb FROM ranked GROUP BY doc_id)
SELECT doc_id, 'family ' || CASE WHEN score > 0 THEN pa WHEN raw > 0 THEN pb END AS family, coalesce(CASE WHEN score > 0 THEN score ELSE raw END, 0) AS score, coalesce(score = 0, true) AS from_raw
FROM documents LEFT JOIN best USING (doc_id)""",
    "ranked_roles": f"""
WITH items AS (SELECT item_id AS role, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM benchmark),
parts AS (SELECT role, 'title' AS field, 3.0::DOUBLE AS w, regexp_extract(t, '^(?:[^ ]+ ){{0,5}}') AS f FROM items UNION ALL SELECT role, 'body', 1, substr(t, length(regexp_extract(t, '^(?:[^ ]+ ){{0,5}}')) + 1) FROM items),
terms AS (SELECT role, field, w, unnest({_TOKENS.format("f")}) AS term FROM parts),
lengths AS (SELECT role, field, count(*) AS n FROM terms GROUP BY ALL),
means AS (SELECT field, avg(n) AS mean FROM lengths GROUP BY field),
held AS (
  SELECT role, term, sum(w * tf / (0.25 + 0.75::DOUBLE * n / mean)) AS tf FROM (SELECT role, field, w, term, count(*) AS tf FROM terms GROUP BY ALL) JOIN lengths USING (role, field) JOIN means USING (field) GROUP BY role, term),
idf AS (SELECT term, ln(1 + ((SELECT count(DISTINCT role) FROM items) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM held GROUP BY term),
asked AS (SELECT doc_id, unnest(list_distinct({_TOKENS.format(_LINE)})) AS term FROM documents),
scores AS (SELECT doc_id, role, round(sum(idf * tf / (1.2::DOUBLE + tf)), 6) AS bm25f FROM asked JOIN held USING (term) JOIN idf USING (term) GROUP BY doc_id, role),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bm25f DESC, role) AS rank, max(bm25f) OVER (PARTITION BY doc_id) AS best FROM scores)
SELECT doc_id, role, rank, bm25f, round(least(1, greatest(0.5, 1.5 * bm25f / best)), 4) AS confidence FROM ranked WHERE rank <= 3""",
    "owner_levels": timeline_queries._DATED + f"""
SELECT *, CASE WHEN studying OR n_posts = 0 THEN 'entry' ELSE 'mid_senior' END AS level FROM (
  SELECT owner, bool_or(section = 'education' AND (present OR expected OR coalesce("end" > {timeline_queries.NOW}, false))) AS studying, count(*) FILTER (section = 'experience' AND NOT part_time) AS n_posts FROM d GROUP BY owner)""",
}
