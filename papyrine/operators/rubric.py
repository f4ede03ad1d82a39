"""The nine-rule rubric of 100 points for documents read as career documents: every rule is a share of its maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import text_of, words

# Maxima of the rules, essential and standard section names, and unprofessional parts of addresses.
MOST = {"extractability": 20, "sections": 15, "formatting": 15, "contact": 10, "headings": 10, "dates": 10, "skills": 10, "links": 5, "parsing": 5}
ESSENTIAL = ["experience", "education", "skills"]
STANDARD = ["summary", "education", "experience", "skills", "projects", "certifications", "achievements", "publications", "volunteer", "languages", "interests", "references", "courses", "training", "extracurricular", "leadership"]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9(][0-9 ().-]{8,}[0-9]"
UNPROFESSIONAL = ["sexy", "hot", "cool", "420", "69"]


def document_features(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """What the rules look at: lengths, headings, contact data, years, skills of lexicon and links, from the text alone."""
    text = text_of(F.col("text"))
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x))
    headings = F.transform(F.filter(lines, lambda x: (F.length(x).between(1, 40)) & ~x.rlike(r"[0-9@|]")), lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z ]", "")))
    return docs.select(
        "doc_id", F.length(F.btrim(text)).alias("n_chars"), F.size(words(F.col("text"))).alias("n_words"), headings.alias("headings"),
        F.lower(F.regexp_extract(text, EMAIL, 0)).alias("email"), text.rlike(PHONE).alias("has_phone"), (F.element_at(lines, 1) != "").alias("has_name"),
        F.regexp_extract_all(text, F.lit(r"(^|[^0-9])((19|20)[0-9]{2})([^0-9]|$)"), F.lit(2)).alias("years"),
        F.size(F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_+#.-]+"), F.lit(0))), F.array(*map(F.lit, lexicon)))).alias("n_skills"),
        F.regexp_extract_all(text, F.lit(r"[a-z]+://[^ \n]+"), F.lit(0)).alias("links"), text.rlike(r" \| ").alias("has_tables"),
    )


def rule_scores(features: DataFrame, latest_year: int) -> DataFrame:
    """doc_id and one column per rule, each between 0 and its maximum, to one decimal."""
    known = F.array_intersect("headings", F.array(*map(F.lit, STANDARD)))
    essential = F.size(F.array_except(F.array(*map(F.lit, ESSENTIAL)), F.col("headings")))
    duplicated = F.size("headings") > F.size(F.array_distinct("headings"))
    future = F.size(F.filter("years", lambda y: y.cast("int") > latest_year))
    bad_links = F.size(F.filter("links", lambda x: ~x.rlike("^https?://")))
    none = F.size("headings") == 0

    def less(*parts: tuple[Column, Column | float]) -> Column:
        return 1.0 - sum(F.when(c, F.lit(v).cast("double") if isinstance(v, float) else v.cast("double")).otherwise(0.0) for c, v in parts)

    n = F.col("n_words")
    shares = {
        "extractability": F.when(F.col("n_chars") < 50, 0.0).otherwise(less((n < 100, 0.3), (n < 50, 0.2))),
        "sections": F.when(none, 0.2).otherwise(less((F.lit(True), 0.15 * essential), (duplicated, 0.1))),
        "formatting": less((F.col("has_tables"), 0.2)),
        "contact": less((~F.coalesce("has_name", F.lit(False)), 0.3), (F.col("email") == "", 0.3), (F.exists(F.array(*map(F.lit, UNPROFESSIONAL)), lambda w: F.contains("email", w)), 0.1), (~F.col("has_phone"), 0.2)),
        "headings": F.when(none, 0.0).otherwise(F.size(known) / F.greatest(F.size(F.array_distinct("headings")), F.lit(1))),
        "dates": less((F.size("years") == 0, 0.3), (F.lit(True), 0.2 * future)),
        "skills": F.when(F.col("n_skills") == 0, 0.0).otherwise(less((F.col("n_skills") < 5, 0.2))),
        "links": less((F.col("email") == "", 0.3), (F.lit(True), 0.1 * bad_links)),
        "parsing": less((none, 0.4), ((F.col("email") == "") & ~F.coalesce("has_name", F.lit(False)), 0.1), (essential >= 2, 0.2)),
    }
    return features.select("doc_id", *(F.round(F.greatest(F.lit(0.0), MOST[k] * v), 1).alias(k) for k, v in shares.items()))


def totals(scores: DataFrame) -> DataFrame:
    """doc_id, total, weakest rule (the least share of its maximum, the first of equals)."""
    shares = F.array(*(F.struct((F.col(k) / MOST[k]).alias("share"), F.lit(i).alias("i"), F.lit(k).alias("rule")) for i, k in enumerate(MOST)))
    return scores.select("doc_id", F.round(sum(F.col(k) for k in MOST), 1).alias("total"), F.array_min(shares)["rule"].alias("weakest"))
