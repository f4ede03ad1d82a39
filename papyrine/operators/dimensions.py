"""The dimensions of a match between a career document and a posting, and their total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the dimensions.
WEIGHTS = {"required": 20, "preferred": 5, "experience": 5, "projects": 5, "responsibilities": 5, "education": 5, "semantic": 55}


def word_set(text: Column, least: int) -> Column:
    """Distinct lower-cased words of at least so many characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"[a-z0-9_]{{{least},}}"), F.lit(0)))


def confidence(skill: Column, owned: Column) -> Column:
    """1 if owned, .6 if a word with the same first five letters is, .4 if one contains the other, else 0."""
    long = F.length(skill) >= 6
    related = long & F.exists(owned, lambda o: (F.length(o) >= 6) & (F.substring(o, 1, 5) == F.substring(skill, 1, 5)))
    return F.when(F.array_contains(owned, skill), 1.0).when(related, 0.6).when(F.exists(owned, lambda o: F.contains(o, skill) | F.contains(skill, o)), 0.4).otherwise(0.0)


def _share(parts: Column, good) -> Column:
    return F.size(F.filter(parts, good)) / F.size(parts)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def dimension_scores(pairs: DataFrame, *keys: str) -> DataFrame:
    """keys and a score for each dimension: null where the posting says nothing about it.

    pairs: keys, text, entries, projects, education (strings of the document; entries and projects arrays), required,
    preferred, requirements, responsibilities, education_requirements (arrays of the posting) and post (its text). Arrays
    are those of one document and one posting, so each row is worked out by itself.
    """
    owned = word_set(F.col("text"), 4)
    keywords = F.array_distinct(F.flatten(F.transform("requirements", lambda r: word_set(r, 3))))
    skills = F.array_distinct(F.concat("required", "preferred"))
    rows = pairs.withColumns({"_owned": owned, "_keywords": keywords, "_skills": skills, "_said": F.lower(F.array_join("entries", " "))})

    def covered(names: str) -> Column:
        # Whole tenths are summed, so the order of the names doesn't matter.
        tenths = F.aggregate(F.transform(names, lambda s: (10 * confidence(s, F.col("_owned"))).cast("int")), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(names) > 0, tenths / (10 * F.size(names)))

    relevance = _mean(F.transform("entries", lambda e: F.size(F.array_intersect(word_set(e, 3), F.col("_keywords"))) / F.greatest(F.size("_keywords"), F.lit(1))))
    experience = F.when(F.size("entries") > 0, F.least(F.lit(1.0), 2 * relevance)).otherwise(0.0)
    projects = F.when(F.size("projects") > 0, F.least(F.lit(1.0), 1.5 * _share(F.col("projects"), lambda p: F.arrays_overlap(word_set(p, 3), F.col("_skills"))))).otherwise(0.0)

    def met(duty: Column) -> Column:
        words = word_set(duty, 4)
        return F.size(F.filter(words, lambda w: F.contains(F.col("_said"), w))) >= 0.3 * F.size(words)

    duties = F.when(F.size("responsibilities") > 0, _share(F.col("responsibilities"), met))
    studied = F.lower(F.coalesce("education", F.lit("")))
    education = F.when(F.size("education_requirements") > 0, F.when(studied == "", 0.0).otherwise(_share(F.col("education_requirements"), lambda r: F.exists(word_set(r, 4), lambda w: F.contains(studied, w)))))
    asked = word_set(F.col("post"), 4)
    union = F.size(F.array_union("_owned", asked))
    semantic = F.when(F.trim("post") != "", F.when(union == 0, 0.0).otherwise(F.least(F.lit(1.0), 5 * F.size(F.array_intersect("_owned", asked)) / union)))
    shares = {"required": covered("required"), "preferred": covered("preferred"), "experience": experience, "projects": projects, "responsibilities": duties, "education": education, "semantic": semantic}
    return rows.select(*keys, *(F.round(WEIGHTS[k] * v, 1).alias(k) for k, v in shares.items()))


def totals(scores: DataFrame, *keys: str) -> DataFrame:
    """keys, total: 100 times the scores by the weights of the dimensions that apply, to one decimal; 0 if none does."""
    got = sum(F.coalesce(k, F.lit(0.0)) for k in WEIGHTS)
    most = sum(F.when(F.col(k).isNotNull(), F.lit(float(v))).otherwise(0.0) for k, v in WEIGHTS.items())
    return scores.select(*keys, F.coalesce(F.round(F.try_divide(100 * got, most), 1), F.lit(0.0)).alias("total"))
