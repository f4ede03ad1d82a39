"""Queries for contact data, skill lists, dates as written and credentials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import contacts
from papyrine.plans import timeline_queries
from papyrine.plans.grading_queries import q
from papyrine.tables import table

_NOTES = """
  SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN concat('code at https://github.com/', replace(c_name, '#', '-'), '/ and more') WHEN 1 THEN 'see github.com/topics for it' WHEN 2 THEN concat('B.Sc., CGPA: ', c_custkey % 10, '.', c_custkey % 7, ' / 10')
    WHEN 3 THEN concat('certified, Credential ID: AB-', c_custkey, 'X') ELSE concat('grade ', c_custkey % 4, ', www.GitHub.com/u', c_custkey) END AS note FROM {customer}"""


def skill_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contacts.skill_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "line", "category", F.size("skills").cast("long").alias("n_skills"), F.md5(F.array_join("skills", "|")).alias("skills"))


def date_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline_queries._entries(spark, sf_dir).select("id", *contacts.date_pair(F.col("dates"))).filter("from_text is not null")


def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = spark.sql(_NOTES, customer=table(spark, sf_dir, "customer"))
    return notes.select("c_custkey", contacts.username(F.col("note")).alias("username"), contacts.grade_point(F.col("note")).alias("grade_point"), contacts.credential(F.col("note")).alias("credential"))


QUERIES = {
    "contact_fields": lambda s, d: contacts.contact_fields(table(s, d, "documents")),
    "skill_lines": skill_lines,
    "flat_skills": lambda s, d: contacts.flat_skills(contacts.skill_lines(table(s, d, "documents"))),
    "date_pairs": date_pairs,
    "credentials": credentials,
}

_FIELDS = ", ".join(f"nullif(trim(regexp_extract(t, {q(v)})), '') AS {k}" for k, v in {"email": contacts.EMAIL, "phone": contacts.PHONE, "linkedin": contacts.LINKEDIN, "github": contacts.GITHUB}.items())
_CUT = "list_filter(list_transform(regexp_split_to_array({}, '[,|;•·]'), lambda x: trim(x, ' ')), lambda x: x <> '')"
_LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
n AS (SELECT doc_id, line, trim(raw, ' ' || chr(9) || chr(13)) AS text, regexp_extract(trim(raw, ' ' || chr(9) || chr(13)), {q(contacts.SKILL_LINE)}, 1) AS named FROM l),
s AS (SELECT doc_id, line, CASE WHEN named <> '' THEN trim(named, ' ') ELSE 'General' END AS category, named, CASE WHEN named <> '' THEN {_CUT.format(f"trim(regexp_extract(text, {q(contacts.SKILL_LINE)}, 2), ' ')")} ELSE {_CUT.format("text")} END AS skills FROM n WHERE text <> ''),
k AS (SELECT * FROM s WHERE len(skills) > 1 OR (named <> '' AND len(skills) > 0))
"""
_PAIR = ", ".join("coalesce(" + ", ".join(f"nullif(trim(regexp_extract(dates, {q(p)}, {k})), '')" for p in contacts.DATE_PAIRS) + f") AS {name}" for k, name in ((1, "from_text"), (2, "to_text")))
_RESERVED = ", ".join(map(q, contacts.RESERVED))
SQL = {
    "contact_fields": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')[1] AS f FROM documents)
SELECT doc_id, {_FIELDS}, len(list_filter(regexp_extract_all(t, {q(contacts.URL)}), lambda u: NOT regexp_matches(lower(u), 'linkedin|github')))::BIGINT AS n_links,
  CASE WHEN length(f) < 60 AND NOT regexp_matches(f, '@|(?i)http') AND NOT regexp_matches(f, '^\\+?[0-9]') THEN f END AS name FROM d""",
    "skill_lines": _LINES + "SELECT doc_id, line, category, len(skills)::BIGINT AS n_skills, md5(array_to_string(skills, '|')) AS skills FROM k",
    "flat_skills": _LINES + """, e AS (SELECT doc_id, line, unnest(skills) AS skill, unnest(range(0, len(skills))) AS i FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(skill) ORDER BY line, i) AS n FROM e WHERE length(skill) BETWEEN 1 AND 39)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, i) AS place, skill FROM o WHERE n = 1""",
    "date_pairs": f"WITH e AS ({timeline_queries._DUCK}), p AS (SELECT id, {_PAIR} FROM e) SELECT * FROM p WHERE from_text IS NOT NULL",
    "credentials": f"""
WITH n AS ({_NOTES.format(customer="customer")}), u AS (SELECT *, regexp_extract(note, {q(contacts.USER)}, 1) AS name FROM n)
SELECT c_custkey, CASE WHEN name <> '' AND lower(name) NOT IN ({_RESERVED}) THEN name END AS username, nullif(trim(regexp_extract(note, {q(contacts.GPA)}, 3)), '') AS grade_point, nullif(regexp_extract(note, {q(contacts.CREDENTIAL)}, 2), '') AS credential FROM u""",
}
