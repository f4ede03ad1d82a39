"""Writing results: versioned Parquet, lines of text or LaTeX, JSON and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_results(results: DataFrame, path: str, rubric_version: str) -> None:
    """Results below a folder of their rubric's version; a rewrite only replaces that."""
    results.withColumn("rubric_version", F.lit(rubric_version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rubric_version").parquet(path)


def latex_escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\textbackslash "))
    for char in "&%$#_{}":
        out = F.replace(out, F.lit(char), F.lit("\\" + char))
    return F.replace(F.replace(out, F.lit("~"), F.lit("\\textasciitilde ")), F.lit("^"), F.lit("\\textasciicircum "))


def exported_text(sections: DataFrame) -> DataFrame:
    """doc_id and one text of its sections (section, heading, text), in order."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "heading", "text")))
    parts = F.transform("parts", lambda s: F.concat(F.upper(s["heading"]), F.lit("\n"), s["text"]))
    return sections.groupBy("doc_id").agg(ordered.alias("parts")).select("doc_id", F.array_join(parts, "\n\n").alias("text"))


def write_text(rows: DataFrame, path: str) -> None:
    rows.select("text").write.mode("overwrite").option("lineSep", "\n\n").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(f"{path}/json")
    metrics.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
