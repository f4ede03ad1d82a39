"""How statements are worded: openers' strength, figures' places, plain rewrites, and specificity and clarity of a person's statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import text_of, words
from papyrine.operators.statements import MEASURED, METRIC, PRESENT_FORMS

# Openers that hide what was done, passive and first-person wording, links to results and gerunds.
STRONG = (
    "architected spearheaded automated optimized optimised launched led reduced increased cut doubled tripled eliminated accelerated scaled migrated shipped founded negotiated won delivered pioneered redesigned saved"
).split()
HIDING = r"(?i)^(assisted|helped|helping|worked on|working on|responsible for|participated|involved in|part of|tasked with|exposure to|familiar with|learned|learning)([^A-Za-z0-9_]|$)"
PASSIVE = r"(?i)(^|[^A-Za-z0-9_])(was|were|been|being|is|are)\s+[A-Za-z0-9_]+ed([^A-Za-z0-9_]|$)"
FIRST_PERSON = r"(^|[^A-Za-z0-9_])(I|me|my|mine)([^A-Za-z0-9_]|$)"
RESULT = {"achieving": "Achieved", "reducing": "Reduced", "improving": "Improved", "increasing": "Increased", "cutting": "Cut", "resulting in": "Delivered"}
GERUNDS = {
    "developed": "developing", "built": "building", "designed": "designing", "created": "creating", "implemented": "implementing", "engineered": "engineering", "trained": "training", "deployed": "deploying", "optimized": "optimizing",
    "automated": "automating", "integrated": "integrating", "led": "leading", "organized": "organizing", "conducted": "conducting", "analyzed": "analyzing", "evaluated": "evaluating", "researched": "researching", "wrote": "writing",
    "architected": "architecting", "prototyped": "prototyping", "modeled": "modeling",
}
LINKED = r"(?i)^([A-Za-z0-9_]+)\s+(.+?),?\s+(achieving|reducing|improving|increasing|cutting|resulting in)\s+(.+?)\.?$"


def _looked_up(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.lower(key))


def verb_tier(text: Column, strong: list[str] = STRONG) -> Column:
    """3 for an opener that hides what was done, 1 for a strong verb (a parameter), else 2."""
    first = F.lower(F.regexp_extract(text, r"[A-Za-z][A-Za-z0-9_-]*", 0))
    return F.when(F.btrim(text).rlike(HIDING), 3).when(first.isin(strong), 1).otherwise(2)


def metric_phrase(text: Column) -> Column:
    """The first figure with what it measures, as it stands; empty without one. The pattern's edges may take a sign beside it along."""
    phrase = F.regexp_replace(F.regexp_extract(text, METRIC + MEASURED, 0), r"^[^A-Za-z0-9$₹€£#]+", "")
    return F.regexp_replace(F.btrim(phrase, F.lit(" ,;:().")), r"\s+×", "×")


def metric_position(text: Column) -> Column:
    """Words before the first figure, or null."""
    phrase = F.regexp_extract(text, METRIC, 0)
    before = F.substring(text, F.lit(1), F.call_function("instr", text, phrase) - 1)
    return F.when(phrase != "", F.size(words(before)))


def front_load(text: Column) -> Column:
    """'Developed X achieving Y' as 'Achieved Y by developing X.', from the statement's own words; null if it isn't of that form."""
    part = [F.regexp_extract(F.btrim(text), LINKED, k) for k in range(5)]
    gerund, lead = _looked_up(GERUNDS, part[1]), _looked_up(RESULT, F.regexp_replace(part[3], r"\s+", " "))
    return F.when(gerund.isNotNull() & lead.isNotNull(), F.concat(lead, F.lit(" "), part[4], F.lit(" by "), gerund, F.lit(" "), F.regexp_replace(part[2], ",+$", ""), F.lit(".")))


def trim_filler(text: Column) -> Column:
    """The statement without filler; null if nothing changes or twenty characters or fewer are left."""
    focus = F.regexp_replace(text, r"(?i),?\s*(with a focus on|focused on)\s+[^.]*", "")
    ended = F.when((focus != text) & ~F.rtrim(focus).endswith("."), F.concat(F.regexp_replace(focus, "[ ,]+$", ""), F.lit("."))).otherwise(focus)
    bare = F.regexp_replace(ended, r"(?i)(^|[^A-Za-z0-9_])(successfully|effectively|various)\s+", "$1")
    short = F.btrim(F.regexp_replace(F.regexp_replace(bare, r"(?i)(^|[^A-Za-z0-9_])in order to([^A-Za-z0-9_]|$)", "$1to$2"), r"\s{2,}", " "))
    return F.when((short != F.btrim(text)) & (F.length(short) > 20), short)


def specificity(graded: DataFrame, by: str, most: float = 15.0) -> DataFrame:
    """by, score: most times the share of specific statements, less .6 for each vague one up to 4, not below 0."""
    counted = graded.groupBy(by).agg(F.avg(F.col("has_specific").cast("double")).alias("share"), F.sum((F.col("n_vague") > 0).cast("long")).alias("n_vague"))
    return counted.select(by, F.round("share", 6).alias("share"), "n_vague", F.round(F.greatest(F.lit(0.0), most * F.col("share") - F.least(F.lit(4.0), 0.6 * F.col("n_vague"))), 6).alias("score"))


def clarity(statements: DataFrame, by: str, most: float = 15.0) -> DataFrame:
    """by, score: most less 1.5 for over 34 words, .5 for under 6, .75 for the passive, .5 for the first person and .5 for a present-tense opener."""
    text = text_of(F.col("text"))
    n = F.size(words(text))
    opener = F.lower(F.regexp_extract(text, r"^\s*([^\s]+)", 1))
    points = F.when(n > 34, 1.5).when(n < 6, 0.5).otherwise(0.0) + F.when(text.rlike(PASSIVE), 0.75).otherwise(0.0) + F.when(text.rlike(FIRST_PERSON), 0.5).otherwise(0.0) + F.when(opener.isin(PRESENT_FORMS), 0.5).otherwise(0.0)
    return statements.groupBy(by).agg(F.round(F.greatest(F.lit(0.0), most - F.sum(points)), 6).alias("score"), F.count("*").alias("n"))


def top_fixes(findings: DataFrame, owner: str, n: int = 5) -> DataFrame:
    """Of each owner the n findings with most points, one per statement: owner, st, points, severity, rank."""
    severity = F.when(F.col("points") >= 5, "high").when(F.col("points") >= 2, "medium").otherwise("low")
    once = Window.partitionBy(owner, "st").orderBy(F.col("points").desc(), "title")
    best = Window.partitionBy(owner).orderBy(F.col("points").desc(), "st")
    kept = findings.withColumn("_n", F.row_number().over(once)).filter("_n = 1").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
    return kept.select(owner, "st", "title", "points", severity.alias("severity"), F.col("rank").cast("long").alias("rank"))


def one_place(x: Column) -> Column:
    """x to one place. A sum of decimals such as 7.35 + 8.2 is a little below its half, which tenths bring back."""
    return F.round(x * 10) / 10


def section_balance(people: DataFrame, most: float = 15.0) -> DataFrame:
    """people with balance: .6 of the sections' part (.7 essential, .3 recommended) and .4 of the pages' part. sections: array, pages: int."""
    def part(names: list[str]) -> Column:
        return F.size(F.array_intersect("sections", F.array(*map(F.lit, names)))) / len(names)

    pages = F.when(F.col("pages") <= 0, 0.8).when(F.col("pages") == 1, 1.0).when(F.col("pages") == 2, 0.9).when(F.col("pages") == 3, 0.6).otherwise(0.3)
    return people.withColumn("balance", F.round(most * (0.6 * (0.7 * part(["experience", "education", "skills"]) + 0.3 * part(["summary", "projects"])) + 0.4 * pages), 6))


def scannability(people: DataFrame, most: float = 10.0) -> DataFrame:
    """people with scannability from mean statements a post (or null), skill categories, skills and the summary's characters."""
    per = F.col("per_post")
    posts = F.when(per.isNull(), 0.3).when(per < 2, 0.3).when(per > 8, 0.5).when(per.between(3, 6), 1.0).otherwise(0.7)
    skills = F.when((F.col("categories") >= 2) & (F.col("skills") > 5), 1.0).when(F.col("categories") >= 1, 0.7).otherwise(0.3)
    summary = F.when(F.col("summary_chars") <= 20, 0.4).when(F.col("summary_chars") <= 300, 1.0).otherwise(0.6)
    return people.withColumn("scannability", F.round(most * (0.4 * posts + 0.3 * skills + 0.3 * summary), 6))


