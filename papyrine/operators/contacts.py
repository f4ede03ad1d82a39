"""Contact data, skill lists, date pairs and credentials in the text of career documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import text_of

# What contact data and pairs of dates look like.
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+"
PHONE = r"(\+?[0-9]{1,3}[-.\s]?)?\(?[0-9]{2,4}\)?[-.\s]?[0-9]{3,4}[-.\s]?[0-9]{3,4}"
LINKEDIN = r"(?i)(https?://)?(www\.)?linkedin\.com/in/[A-Za-z0-9_-]+/?"
GITHUB = r"(?i)(https?://)?(www\.)?github\.com/[A-Za-z0-9_-]+/?"
URL = r"https?://[A-Za-z0-9_./\-?=#%&+]+"
USER = r"(?i)github\.com/([A-Za-z0-9-]+)/?([^A-Za-z0-9_/-]|$)"
RESERVED = ["orgs", "features", "about", "topics", "sponsors"]
DATE_PAIRS = [r"(?i)([A-Za-z0-9_]+\s*[0-9]{4})\s*[-–—to]+\s*(Present|[A-Za-z0-9_]+\s*[0-9]{4})", r"(?i)([0-9]{1,2}/[0-9]{4})\s*[-–—to]+\s*(Present|[0-9]{1,2}/[0-9]{4})", r"(?i)([0-9]{4})\s*[-–—to]+\s*(Present|[0-9]{4})"]
SKILL_LINE = r"^([^:|\-–—]+?)\s*[:|—\-–]\s*(.+)$"
GPA = r"(?i)(^|[^A-Za-z0-9_])(c?gpa|grade)\s*[:\-]?\s*([0-9]+(\.[0-9]+)?(\s*/\s*[0-9]+(\.[0-9]+)?)?)"
CREDENTIAL = r"(?i)credential\s*(id)?\s*[:#]?\s*([A-Za-z0-9-]{5,})"


def _or_null(found: Column) -> Column:
    return F.when(found != "", found)


def contact_fields(docs: DataFrame) -> DataFrame:
    """doc_id, email, phone, linkedin, github, n_links, name: the first of each in the text; the name is a short plain first line."""
    text = text_of(F.col("text"))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    plain = (F.length(first) < 60) & ~first.rlike("@|(?i)http") & ~first.rlike(r"^\+?[0-9]")
    links = F.filter(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: ~F.lower(u).rlike("linkedin|github"))
    fields = {"email": EMAIL, "phone": PHONE, "linkedin": LINKEDIN, "github": GITHUB}
    return docs.select("doc_id", *(_or_null(F.btrim(F.regexp_extract(text, v, 0))).alias(k) for k, v in fields.items()), F.size(links).cast("long").alias("n_links"), F.when(plain, first).alias("name"))


def skill_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line, category, skills (array): lines of the form category: a, b, or of two skills or more."""
    lines = docs.select("doc_id", F.posexplode(F.split(text_of(F.col("text")), "\n")).alias("line", "raw")).select("doc_id", F.col("line").cast("long").alias("line"), F.btrim("raw", F.lit(" \t\r")).alias("text")).filter("text <> ''")

    def cut(c: Column) -> Column:
        return F.filter(F.transform(F.split(c, "[,|;•·]"), lambda x: F.btrim(x)), lambda x: x != "")

    named = F.regexp_extract("text", SKILL_LINE, 1)
    rows = lines.withColumns({"category": F.when(named != "", F.btrim(named)).otherwise("General"), "skills": F.when(named != "", cut(F.btrim(F.regexp_extract("text", SKILL_LINE, 2)))).otherwise(cut(F.col("text"))), "_named": named != ""})
    return rows.filter((F.size("skills") > 1) | (F.col("_named") & (F.size("skills") > 0))).select("doc_id", "line", "category", "skills")


def flat_skills(lines: DataFrame, longest: int = 40) -> DataFrame:
    """doc_id, place, skill: a document's skills in order, once whatever the case, shorter than longest characters."""
    every = lines.select("doc_id", "line", F.posexplode("skills").alias("i", "skill")).filter((F.length("skill") < longest) & (F.length("skill") > 0))
    once = Window.partitionBy("doc_id", F.lower("skill")).orderBy("line", "i")
    order = Window.partitionBy("doc_id").orderBy("line", "i")
    kept = every.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    return kept.select("doc_id", F.row_number().over(order).cast("long").alias("place"), "skill")


def date_pair(column: Column) -> list[Column]:
    """start and end as written, by the first of three patterns that is found; null without one."""
    text = text_of(column)
    return [F.coalesce(*(_or_null(F.btrim(F.regexp_extract(text, p, k))) for p in DATE_PAIRS)).alias(name) for k, name in ((1, "from_text"), (2, "to_text"))]


def username(column: Column) -> Column:
    """The first user's name in an address of a code host, or null if it is a reserved word."""
    found = F.regexp_extract(text_of(column), USER, 1)
    return F.when((found != "") & ~F.lower(found).isin(RESERVED), found)


def grade_point(column: Column) -> Column:
    return _or_null(F.btrim(F.regexp_extract(text_of(column), GPA, 3)))


def credential(column: Column) -> Column:
    return _or_null(F.regexp_extract(text_of(column), CREDENTIAL, 2))
