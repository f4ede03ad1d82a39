"""The four collections of knowledge files as chunks: chunk_id, collection, title, text, metadata (a map of strings)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import norms

SKILLS = "skill_relationships array<struct<source_skill:string,related:array<struct<skill:string,relation:string,transferability:double,rationale:string>>>>"
GUIDANCE = "guidelines array<struct<id:string,title:string,summary:string,explanation:string,good_example:string,category:string>>"
PROJECTS = "project_archetypes array<struct<id:string,title:string,difficulty:string,gap_skills:array<string>,suggested_stack:array<string>,deliverables:array<string>,resume_bullet_template:string>>"


def _files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def _chunks(rows: DataFrame, collection: str, key: Column, title: Column, text: list[Column], **metadata: Column) -> DataFrame:
    """Parts of a text are joined; nulls in it are left out, so that a missing field never takes the chunk with it."""
    held = F.create_map(*(x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))))
    return rows.select(key.alias("chunk_id"), F.lit(collection).alias("collection"), title.alias("title"), F.concat_ws("", *text).alias("text"), held.alias("metadata"))


def _listed(name: str, sign: str = ", ") -> Column:
    return F.array_join(F.coalesce(name, F.array().cast("array<string>")), sign)


def role_norms(spark: SparkSession, path: str) -> DataFrame:
    """A chunk for each role and level."""
    rows = norms.norm_table(_files(spark, path, norms.SCHEMA))
    level, s = F.initcap("level"), F.lit
    text = [s("Role: "), F.col("title"), s(" ("), level, s(" Level). Expected sections: "), _listed("expected_sections"), s(". Typical tools: "), _listed("typical_tools"), s(". Expected metrics: "), _listed("expected_metrics"), s(". Anti-patterns: "), _listed("anti_patterns", "; "), s(".")]
    return _chunks(rows, "role_norms", F.concat_ws("_", s("norm"), "role", "level"), F.concat_ws("", "title", s(" ("), level, s(" Norms)")), text, role_family=F.col("family"), role_id=F.col("role"), role_title=F.col("title"), seniority=F.col("level"))


def skill_links(spark: SparkSession, path: str) -> DataFrame:
    """A chunk for each pair of related skills; a link without a figure is carried over by .7."""
    items = _files(spark, path, SKILLS).select(F.explode("skill_relationships").alias("i")).select(F.col("i.source_skill").alias("source"), F.explode("i.related").alias("r")).select("source", "r.*")
    share = F.coalesce("transferability", F.lit(0.7))
    s = F.lit
    text = [s("Skill relationship: "), F.col("source"), s(" relates to "), F.col("skill"), s(" ("), F.col("relation"), s(", transferability "), F.bround(100 * share, 0).cast("int").cast("string"), s("%). Rationale: "), F.col("rationale")]
    return _chunks(items, "skill_relationships", F.concat_ws("_", s("skill_rel"), F.lower("source"), F.lower("skill")), F.concat_ws("", s("Skill Link: "), "source", s(" -> "), "skill"), text, source_skill=F.col("source"), target_skill=F.col("skill"), transferability=share)


def guidance(spark: SparkSession, path: str) -> DataFrame:
    rows = _files(spark, path, GUIDANCE).select(F.explode("guidelines").alias("g")).select("g.*")
    s = F.lit
    example = F.when(F.coalesce("good_example", s("")) != "", F.concat(s(" Good example: "), F.col("good_example")))
    return _chunks(rows, "writing_guidance", F.col("id"), F.col("title"), [F.col("title"), s(": "), F.col("summary"), s(" "), F.col("explanation"), example], category=F.col("category"))


def projects(spark: SparkSession, path: str) -> DataFrame:
    rows = _files(spark, path, PROJECTS).select(F.explode("project_archetypes").alias("p")).select("p.*")
    s = F.lit
    text = [s("Project: "), F.col("title"), s(" (Difficulty: "), F.col("difficulty"), s("). Gap skills addressed: "), _listed("gap_skills"), s(". Suggested stack: "), _listed("suggested_stack"), s(". Deliverables: "), _listed("deliverables", "; "), s(". Resume bullet template: "), F.col("resume_bullet_template")]
    return _chunks(rows, "project_archetypes", F.col("id"), F.col("title"), text, difficulty=F.col("difficulty"), gap_skills=_listed("gap_skills"), suggested_stack=_listed("suggested_stack"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All four collections of a folder with role_norms/*.json and a file for each of the others."""
    out = role_norms(spark, f"{folder}/role_norms/*.json")
    for read, name in ((skill_links, "skill_relationships"), (guidance, "writing_guidance"), (projects, "project_archetypes")):
        out = out.unionByName(read(spark, f"{folder}/{name}.json"))
    return out
