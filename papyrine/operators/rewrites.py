"""Rewrites of statements: labelled perturbations, the number gate on them, anchors of texts, and placement on lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators import facts

#: Kinds of perturbation, and whether a rewrite of the kind is faithful.
FAITHFUL = {"trim": True, "reorder": True, "swap_opener": True, "add_percent": False, "add_count": False, "inflate_number": False}
GATES = {"fabrication": ("<=", 0.02), "well_formed": (">=", 0.99), "judge": (">=", 0.70), "star": (">=", 0.85)}


def perturbed(rows: DataFrame) -> DataFrame:
    """rows with kind, rewrite and faithful for each perturbation of text that changes something.

    trim keeps the first three quarters of the words; reorder puts the part after the first comma first; swap_opener
    replaces the first word; the others add or enlarge a figure.
    """
    text = F.col("text")
    words = F.split(text, " ")
    trim = F.array_join(F.slice(words, 1, F.greatest(F.lit(1), F.floor(F.size(words) * 3 / 4).cast("int"))), " ")
    reorder = F.regexp_replace(text, r"^([^,]+), *(.+)$", "$2, $1")
    first = F.regexp_extract(text, "[0-9]+", 0)
    # Three times the figure and seven, in decimals so that a figure of any length is enlarged.
    larger = F.when(F.length(first) <= 36, (F.expr("try_cast(nullif(regexp_extract(text, '[0-9]+', 0), '') as decimal(38,0))") * 3 + 7).cast("string")).otherwise(F.concat(F.lit("9"), first))
    inflated = F.when(first != "", F.concat(F.regexp_extract(text, "^[^0-9]*", 0), larger, F.regexp_replace(text, "^[^0-9]*[0-9]+", ""))).otherwise(text)
    made = {"trim": trim, "reorder": reorder, "swap_opener": F.regexp_replace(text, r"^[^ ]+", "Delivered"), "add_percent": F.concat(text, F.lit(" by 37%")), "add_count": F.concat(text, F.lit(" for 4321 users")), "inflate_number": inflated}
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("rewrite"), F.lit(FAITHFUL[k]).alias("faithful")) for k, v in made.items()))
    return rows.select("*", F.explode(kinds).alias("p")).select(*rows.columns, "p.kind", "p.rewrite", "p.faithful").filter(F.col("rewrite").isNotNull() & (F.col("rewrite") != F.col("text")))


def number_gate(rows: DataFrame, partners: int | None = None) -> DataFrame:
    """rows with accepted: no number of rewrite is unsupported by text; partners as for the check of numbers."""
    return facts.check_numbers(rows, "rewrite", "text", partners).withColumn("accepted", F.col("n_unsupported") == 0)


def gate_matrix(rows: DataFrame) -> DataFrame:
    """By kind: rewrites, accepted ones, and how many were judged right."""
    right = F.col("accepted") == F.col("faithful")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("accepted").cast("long")).alias("n_accepted"), F.sum(right.cast("long")).alias("n_right"))


def ship_decision(measures: dict[str, float]) -> dict[str, bool]:
    """Which deployment gates the measures pass."""
    return {k: (measures[k] <= v if sign == "<=" else measures[k] >= v) for k, (sign, v) in GATES.items()}


def capped_mix(rows: DataFrame, task: str, caps: dict[str, int], key: str) -> DataFrame:
    """Up to each task's cap of rows, by the md5 of the key; tasks without a cap are left out."""
    order = Window.partitionBy(task).orderBy(F.md5(F.col(key).cast("string")), key)
    cap = F.coalesce(*(F.when(F.col(task) == k, F.lit(v)) for k, v in caps.items()), F.lit(0))
    return rows.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= cap).drop("_at")


def agreeing(first: DataFrame, second: DataFrame, key: str, verdict: str) -> DataFrame:
    """Rows of first whose verdict a second run repeats."""
    return first.join(second.select(key, F.col(verdict).alias("_again")), key).filter(F.col(verdict) == F.col("_again")).drop("_again")


def anchors(texts: DataFrame, statements: DataFrame, least: float = 0.5) -> DataFrame:
    """owner, id, st, score: the statement (owner, st, tokens) that shares most of a text's tokens (owner, id, tokens), if least or more.

    Both come with arrays of tokens and are joined on owner and token, so only statements that share one are looked at.
    """
    asked = texts.select("owner", "id", F.size(F.array_distinct("tokens")).alias("n"), F.explode(F.array_distinct("tokens")).alias("token"))
    said = statements.select("owner", "st", F.explode(F.array_distinct("tokens")).alias("token"))
    shared = asked.join(said, ["owner", "token"]).groupBy("owner", "id", "st").agg((F.count("*") / F.first("n")).alias("score"))
    best = Window.partitionBy("owner", "id").orderBy(F.col("score").desc(), "st")
    return shared.filter(F.col("score") >= least).withColumn("_at", F.row_number().over(best)).filter("_at = 1").select("owner", "id", "st", F.round("score", 6).alias("score"))


def placed_units(units: DataFrame, lines: DataFrame, grid: float = 32.0) -> DataFrame:
    """doc_id, unit, line: the first line whose box (2 higher and lower, 3 wider) holds the unit's centre.

    units: doc_id, page, unit, cx, cy. lines: doc_id, page, line, x0, y0, x1, y1. Lines are put in every band of the
    page they touch, so a unit meets only those of its own band.
    """
    cut = lines.withColumn("band", F.explode(F.sequence(F.floor((F.col("y0") - 2) / grid), F.floor((F.col("y1") + 2) / grid))))
    found = units.withColumn("band", F.floor(F.col("cy") / grid)).join(cut, ["doc_id", "page", "band"])
    inside = F.col("cx").between(F.col("x0") - 3, F.col("x1") + 3) & F.col("cy").between(F.col("y0") - 2, F.col("y1") + 2)
    return found.filter(inside).groupBy("doc_id", "unit").agg(F.min("line").alias("line"))
