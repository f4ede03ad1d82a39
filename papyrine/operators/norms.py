"""What is expected of a role at a level, and how far a document has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import text_of

# The points, what each thing that is missing costs, and words that tell of a comparison.
MOST, WITHOUT_NORM, SECTION, TOOLS, METRICS, BASELINE = 10.0, 5.0, 1.5, 3.0, 1.0, 1.0
COMPARED = r"baseline|compared|vs\.?|outperform"
UNSHOWN, GROUP, GROUPS, TOPICS = 5.0, 0.75, 2.0, 1.0
#: Norms as JSON: a family with roles, each with a map of levels.
LEVEL = "struct<expected_sections:array<string>,typical_tools:array<string>,expected_metrics:array<string>,anti_patterns:array<string>>"
SCHEMA = f"role_family string, roles array<struct<id:string,canonical_title:string,aliases:array<string>,seniority_levels:map<string,{LEVEL}>>>"


def norm_table(files: DataFrame) -> DataFrame:
    """role, family, title, level, place, expected_sections, typical_tools, expected_metrics, anti_patterns of SCHEMA rows.

    place is the level's place in its role. Lists that are null are empty.
    """
    roles = files.select(F.coalesce("role_family", F.lit("General")).alias("family"), F.explode("roles").alias("r"))
    rows = roles.select("family", F.col("r.id").alias("role"), F.col("r.canonical_title").alias("title"), F.posexplode(F.map_entries("r.seniority_levels")).alias("place", "e"))
    lists = [F.coalesce(F.col(f"e.value.{c}"), F.array().cast("array<string>")).alias(c) for c in ("expected_sections", "typical_tools", "expected_metrics", "anti_patterns")]
    return rows.select("role", "family", "title", F.col("e.key").alias("level"), F.col("place").cast("long").alias("place"), *lists)


def chosen(people: DataFrame, norms: DataFrame) -> DataFrame:
    """people (doc_id, role, family, level) with fit and the norm's columns: that of the role and level (fit 0), else the role's
    first level (1), else the family's at this level (2), else null (3); among equals the smaller role and place.

    Norms are tried for each role, family and level that somebody has, once for all people that share them.
    """
    held = ["expected_sections", "typical_tools", "expected_metrics", "anti_patterns"]
    norm = F.struct(F.col("n.role").alias("norm_role"), F.col("n.level").alias("norm_level"), *(F.col(f"n.{c}").alias(c) for c in held))
    keys = ["role", "family", "level"]
    asked = people.select(*keys).distinct()
    own = asked.alias("p").join(norms.alias("n"), F.col("p.role") == F.col("n.role")).select(*(f"p.{c}" for c in keys), F.when(F.col("p.level") == F.col("n.level"), 0).otherwise(1).alias("fit"), F.col("n.place").alias("place"), norm.alias("norm"))
    kin = asked.alias("p").join(norms.alias("n"), (F.col("p.family") == F.col("n.family")) & (F.col("p.level") == F.col("n.level"))).select(*(f"p.{c}" for c in keys), F.lit(2).alias("fit"), F.col("n.place").alias("place"), norm.alias("norm"))
    best = own.unionByName(kin).groupBy(*keys).agg(F.min_by("norm", F.struct("fit", "place", F.col("norm.norm_role"))).alias("norm"), F.min("fit").alias("fit"))
    best = best.select(*(F.col(c).alias(f"_{c}") for c in keys), "norm", "fit")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return people.join(best, same, "left").select(*people.columns, F.coalesce("fit", F.lit(3)).alias("fit"), "norm.*")


def _missing_metrics(text: Column, metrics: Column) -> Column:
    """Metrics of which neither of the first two long words is in the text."""
    return F.filter(metrics, lambda m: ~F.exists(F.slice(F.regexp_extract_all(F.lower(m), F.lit("[a-z]{4,}"), F.lit(0)), 1, 2), lambda w: F.contains(text, w)))


def alignment(people: DataFrame) -> DataFrame:
    """doc_id, missing_sections, missing_tools, missing_metrics, unlike (anti-patterns about baselines), score of chosen() rows.

    people also has kinds (array of section kinds) and text. Without a norm the score is WITHOUT_NORM.
    """
    low = F.lower(text_of(F.col("text")))
    rows = people.withColumns({
        "missing_sections": F.array_except("expected_sections", "kinds"), "missing_tools": F.filter("typical_tools", lambda t: ~F.contains(low, F.lower(t))), "missing_metrics": _missing_metrics(low, F.col("expected_metrics")),
        "unlike": F.when(low.rlike(COMPARED), 0).otherwise(F.size(F.filter("anti_patterns", lambda a: F.contains(F.lower(a), F.lit("baseline"))))),
    })
    tools = F.when(F.size("typical_tools") > 0, TOOLS * F.size("missing_tools") / F.size("typical_tools")).otherwise(0.0)
    score = MOST - SECTION * F.size("missing_sections") - tools - METRICS * (F.size("missing_metrics") > 0).cast("int") - BASELINE * F.col("unlike")
    zero = F.lit(0)
    counts = [F.coalesce(F.when(F.col("fit") < 3, F.size(c)), zero).cast("long").alias(c) for c in ("missing_sections", "missing_tools", "missing_metrics")]
    return rows.select("doc_id", "fit", *counts, F.coalesce(F.when(F.col("fit") < 3, F.col("unlike")), zero).cast("long").alias("unlike"), F.round(F.when(F.col("fit") == 3, WITHOUT_NORM).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(MOST), score))), 4).alias("score"))


def narrative(listed: DataFrame, shown: DataFrame, groups: DataFrame, topics: DataFrame, most: float = MOST) -> DataFrame:
    """doc_id, listed, unshown, off_groups, unsupported, score.

    listed: doc_id, skill; shown: doc_id, skill (what entries and statements hold, lower-cased): skills without a row there
    are unshown. groups: doc_id, category (groups that lead away from the profile); topics: doc_id, topic (claimed, with no
    row in shown unsupported). All comparisons are anti-joins on whole phrases.
    """
    known = shown.select("doc_id", F.lower("skill").alias("phrase")).distinct()
    skills = listed.select("doc_id", F.lower("skill").alias("phrase"))
    lost = skills.join(known, ["doc_id", "phrase"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("unshown"))
    open_topics = topics.select("doc_id", F.lower("topic").alias("phrase")).distinct().join(known, ["doc_id", "phrase"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("unsupported"))
    off = groups.groupBy("doc_id").agg(F.countDistinct("category").alias("off_groups"))
    rows = skills.groupBy("doc_id").agg(F.count("*").alias("listed"))
    for other in (lost, off, open_topics):
        rows = rows.join(other, "doc_id", "full")
    rows = rows.na.fill(0, ["listed", "unshown", "off_groups", "unsupported"])
    score = most - UNSHOWN * F.coalesce(F.try_divide(F.col("unshown"), F.col("listed")), F.lit(0.0)) - F.least(F.lit(GROUPS), GROUP * F.col("off_groups")) - TOPICS * (F.col("unsupported") > 0).cast("int")
    return rows.select("doc_id", "listed", "unshown", "off_groups", "unsupported", F.round(F.greatest(F.lit(0.0), score), 4).alias("score"))
