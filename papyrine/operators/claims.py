"""Claims of projects against repositories: which repository a project is, what it shows, and what no repository shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import text_of
from papyrine.operators.roles import phrases

# Addresses of repositories, names of languages and packages that stand for others, files that list packages,
# in order, of which the first FILES are read; the least share of a name, and months between a start and a repository.
REPOSITORY = r"(?i)github\.com/([A-Za-z0-9-]{1,39})/([A-Za-z0-9_.-]{1,100})"
LANGUAGES = {"Jupyter Notebook": "Python", "HCL": "Terraform", "Dockerfile": "Docker", "Vue": "Vue.js", "Shell": "Bash"}
PACKAGES = {
    "psycopg2": "PostgreSQL", "psycopg": "PostgreSQL", "asyncpg": "PostgreSQL", "pg": "PostgreSQL", "redis": "Redis", "ioredis": "Redis", "torch": "PyTorch", "tensorflow": "TensorFlow",
    "pymongo": "MongoDB", "mongoose": "MongoDB", "mysqlclient": "MySQL", "mysql2": "MySQL", "sklearn": "scikit-learn", "scikit-learn": "scikit-learn", "boto3": "AWS", "aws-sdk": "AWS",
    "@aws-sdk/client-s3": "AWS", "kafka-python": "Kafka", "confluent-kafka": "Kafka", "kafkajs": "Kafka", "celery": "Celery", "pika": "RabbitMQ", "amqplib": "RabbitMQ", "@nestjs/core": "NestJS",
    "next": "Next.js", "react": "React", "express": "Express.js", "vue": "Vue.js", "@angular/core": "Angular",
}
MANIFESTS = ["requirements.txt", "pyproject.toml", "package.json", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "environment.yml", "Pipfile", "Gemfile", "composer.json"]
FILES, LEAST_TITLE, LEAST_PART, LATE = 3, 3, 4, 3


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text_of(text)), "[^a-z0-9]", "")


def _looked_up(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def matched(projects: DataFrame, repos: DataFrame) -> DataFrame:
    """doc_id, entry_id, how (url, name or none), full_name (or null) of projects: the repository that a project is.

    projects: doc_id, entry_id, username, title, text; repos: username, name, full_name. A linked repository counts even if it
    isn't among repos. By name the title's first part counts: whole names before contained ones, then the smaller full name.
    """
    text = text_of(F.col("text"))
    owner, name = F.regexp_extract(text, REPOSITORY, 1), F.regexp_replace(F.regexp_replace(F.regexp_extract(text, REPOSITORY, 2), r"\.git$", ""), r"\.+$", "")
    title = _normal(F.get(F.split(text_of(F.col("title")), "[|–—:(]"), F.lit(0)))
    rows = projects.select("doc_id", "entry_id", F.lower("username").alias("username"), F.lower(owner).alias("_owner"), F.concat(owner, F.lit("/"), name).alias("_linked"), title.alias("_title"))
    own = repos.select(F.lower("username").alias("username"), "full_name", _normal(F.col("name")).alias("_name")).filter("_name <> ''")
    part = (F.contains("_title", "_name") | F.contains("_name", "_title")) & (F.least(F.length("_name"), F.length("_title")) >= LEAST_PART)
    near = F.when(F.col("_name") == F.col("_title"), 0).when(part, 1)
    linked = F.col("_owner") != ""
    named = rows.filter(~linked & (F.length("_title") >= LEAST_TITLE)).join(own, "username").withColumn("_near", near).filter("_near is not null")
    best = named.groupBy("doc_id", "entry_id").agg(F.min(F.struct("_near", "full_name")).alias("b"))
    # Of a link's spelling the repository's own counts.
    spelt = repos.select(F.lower("full_name").alias("_low"), F.col("full_name").alias("_spelt")).groupBy("_low").agg(F.min("_spelt").alias("_spelt"))
    out = rows.join(best, ["doc_id", "entry_id"], "left").withColumn("_low", F.lower("_linked")).join(spelt, "_low", "left")
    return out.select("doc_id", "entry_id", F.when(linked, "url").when(F.col("b").isNotNull(), "name").otherwise("none").alias("how"), F.when(linked, F.coalesce("_spelt", "_linked")).otherwise(F.col("b.full_name")).alias("full_name"))


def evidence(repos: DataFrame, languages: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """full_name, skill (lower-cased) that a repository shows: by language, description, topics, and packages in its manifests.

    languages: full_name, language; files: full_name, path, content; names: phrase, canonical (what phrases stand for).
    """
    families = names.select(F.col("canonical").alias("family"), F.col("phrase").alias("keyword"))
    spoken = languages.select("full_name", F.coalesce(_looked_up(LANGUAGES, F.col("language")), F.col("language")).alias("skill"))
    place = F.array_position(F.array(*map(F.lit, MANIFESTS)), F.col("path"))
    order = Window.partitionBy("full_name").orderBy(place)
    read = files.filter(place > 0).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= FILES).select("full_name", text_of(F.col("content")).alias("text"))
    told = repos.select("full_name", F.concat_ws(" ", "description", F.array_join("topics", " ")).alias("text")).unionByName(read)
    said = phrases(told.select(F.col("full_name").alias("doc_id"), F.lit("repo").alias("field"), F.translate("text", "-_", "  ").alias("text")), families).select(F.col("doc_id").alias("full_name"), F.col("family").alias("skill"))
    token = read.select("full_name", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[@a-z0-9][A-Za-z0-9_./@-]*"), F.lit(0))).alias("t")).select("full_name", F.get(F.split("t", r"[=<>~^\[;]"), F.lit(0)).alias("t"))
    packed = token.select("full_name", F.coalesce(_looked_up(PACKAGES, F.col("t")), _looked_up(PACKAGES, F.get(F.split("t", "-"), F.lit(0)))).alias("skill")).filter("skill is not null")
    return spoken.unionByName(said).unionByName(packed).select("full_name", F.lower("skill").alias("skill")).distinct()


def checked(projects: DataFrame, repos: DataFrame, shown: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, entry_id, how, full_name, found, not_found (sorted arrays), and the notes is_public, is_fork, is_foreign, is_late.

    projects also has start (months since year 0, or null); repos also has owner, fork, created_at; shown: of evidence(). A
    project without a repository, or with a link to none that is known, has nothing found or not found.
    """
    families = names.select(F.col("canonical").alias("family"), F.col("phrase").alias("keyword"))
    key = F.struct("doc_id", "entry_id")
    said = projects.select(key.alias("doc_id"), F.lit("entry").alias("field"), F.regexp_replace(F.concat_ws(" ", "title", "text"), REPOSITORY, " ").alias("text"))
    claimed = phrases(said, families).select("doc_id.doc_id", "doc_id.entry_id", F.col("family").alias("claim")).distinct()
    facts = repos.select("full_name", F.lower("owner").alias("_owner"), "fork", F.substring("created_at", 1, 7).alias("_month")).dropDuplicates(["full_name"])
    rows = matched(projects, repos).join(facts, "full_name", "left").join(projects.select("doc_id", "entry_id", F.lower("username").alias("_user"), "start"), ["doc_id", "entry_id"])
    known = rows.filter("_owner is not null").select("doc_id", "entry_id", "full_name").join(claimed, ["doc_id", "entry_id"])
    held = known.withColumn("skill", F.lower("claim")).join(shown.withColumn("_shown", F.lit(True)), ["full_name", "skill"], "left")
    lists = held.groupBy("doc_id", "entry_id").agg(F.array_sort(F.collect_set(F.when(F.col("_shown"), F.col("claim")))).alias("found"), F.array_sort(F.collect_set(F.when(F.col("_shown").isNull(), F.col("claim")))).alias("not_found"))
    created = F.when(F.col("_month").rlike("^[0-9]{4}-[0-9]{2}$"), F.substring("_month", 1, 4).cast("int") * 12 + F.substring("_month", 6, 2).cast("int") - 1)
    none = F.array().cast("array<string>")
    public = F.col("full_name").isNotNull() & F.col("_owner").isNotNull()
    return rows.join(lists, ["doc_id", "entry_id"], "left").select(
        "doc_id", "entry_id", "how", "full_name", F.coalesce("found", none).alias("found"), F.coalesce("not_found", none).alias("not_found"), public.alias("is_public"), F.coalesce("fork", F.lit(False)).alias("is_fork"),
        F.coalesce(F.col("_owner") != F.col("_user"), F.lit(False)).alias("is_foreign"), F.coalesce(created - F.col("start") > LATE, F.lit(False)).alias("is_late"),
    )


def verification(checks: DataFrame) -> DataFrame:
    """doc_id, n_projects, n_matched, n_claims, cvi: the percentage of claims that repositories show; null without claims."""
    claims = F.sum(F.size("found") + F.size("not_found"))
    rows = checks.groupBy("doc_id").agg(F.count("*").alias("n_projects"), F.sum(F.col("is_public").cast("long")).alias("n_matched"), claims.alias("n_claims"), F.sum(F.size("found")).alias("_found"))
    return rows.select("doc_id", "n_projects", "n_matched", "n_claims", F.round(F.try_divide(100.0 * F.col("_found"), F.col("n_claims")), 1).alias("cvi"))
