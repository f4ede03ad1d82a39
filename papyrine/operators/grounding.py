"""Whether what a rewrite says is grounded: named things, their canonical and general names, and the gate on both kinds of facts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import text_of
from papyrine.operators import facts
from papyrine.storage import materialize

#: Stands before tokens that begin a sentence.
MARK = "\x01"
#: Signs after which a capital says nothing; a full stop only before white space.
AFTER_BREAK = r"([!?;:—–(\[]\s*|\.\s+)([A-Za-z])"
TOKEN = MARK + r"?(?:[A-Za-z][A-Za-z0-9_+#./-]*[A-Za-z0-9_+#]|[A-Za-z])"
WORD = "[a-z0-9_+#]+"


def normal(column: Column) -> Column:
    """Lower-cased words with one space between, so that a phrase is found at word edges by containment."""
    return F.array_join(F.regexp_extract_all(F.lower(text_of(column)), F.lit(WORD), F.lit(0)), " ")


def holds(text: Column, phrase: Column) -> Column:
    """A normal text has a normal phrase."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def phrases(column: Column, longest: int = 4) -> Column:
    """Distinct runs of 1 to longest words of a normal text; longer runs are made of shorter ones and the next word."""
    def runs(words: Column) -> Column:
        found = [words]
        for n in range(1, longest):
            left = F.greatest(F.size(words) - n, F.lit(0))
            found.append(F.zip_with(F.slice(found[-1], F.lit(1), left), F.slice(words, n + 1, left), lambda a, b: F.concat(a, F.lit(" "), b)))
        return F.concat(*found)

    # Within the lambda the words are split once.
    return F.array_distinct(F.flatten(F.transform(F.array(F.split(column, " ")), runs)))


def mentions(rows: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """key, canonical of every name (phrase, canonical) in a normal text. Texts' phrases are joined with the names."""
    return rows.select(key, F.explode(phrases(F.col(text))).alias("phrase")).join(names, "phrase").select(key, "canonical").distinct()


def key_terms(rows: DataFrame, key: str, text: str, names: DataFrame, ambiguous: list[str]) -> DataFrame:
    """key, term, phrase: what a text could have made up.

    Tokens with two capitals, a later capital or a digit; capitalised tokens that don't begin a sentence; known names of
    over two letters that aren't everyday words as well; and canonical names of several words. names: phrase, canonical.
    """
    said = F.regexp_replace(F.regexp_replace(text_of(F.col(text)), r"^(\s*)([A-Za-z])", f"$1{MARK}$2"), AFTER_BREAK, f"$1{MARK}$2")
    tokens = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(said, F.lit(TOKEN), F.lit(0)))).alias("t"))
    tokens = tokens.select(key, F.replace("t", F.lit(MARK), F.lit("")).alias("term"), F.startswith("t", F.lit(MARK)).alias("first")).withColumn("phrase", normal(F.col("term")))
    known = tokens.join(names.select("phrase", F.lit(True).alias("known")).distinct(), "phrase", "left")
    rest = F.expr("substring(term, 2)")
    strong = F.col("term").rlike("[A-Z].*[A-Z]|[0-9]") | (rest != F.lower(rest))
    named = F.coalesce("known", F.lit(False)) & (F.length("term") > 2) & ~F.lower("term").isin(ambiguous)
    single = known.filter(strong | (F.col("term").rlike("^[A-Z]") & ~F.col("first")) | named).select(key, "term", "phrase")
    whole = mentions(rows.select(key, normal(F.col(text)).alias("n")), key, "n", names).filter(F.contains("canonical", F.lit(" ")))
    return single.unionByName(whole.select(key, F.col("canonical").alias("term"), normal(F.col("canonical")).alias("phrase"))).distinct()


def validated(rows: DataFrame, key: str, names: DataFrame, generals: DataFrame, ambiguous: list[str], partners: int | None = None) -> DataFrame:
    """key, n_terms, n_literal, n_alias, n_general, bad_terms, n_bad_numbers, n_derived, valid of rows (key, rewrite, ground).

    A term is supported if the ground has it word for word, has another name of the same thing, or has a thing it is a
    general name of (generals: canonical, general). A term with digits is also fine if its numbers are grounded and what
    is left of it is supported. Every number must be grounded; those derived from grounded ones, of which partners are
    looked at if given, are counted.
    """
    numbers = facts.check_numbers(rows, "rewrite", "ground", partners).select(key, F.col("n_unsupported").alias("n_bad_numbers"), "n_derived")
    ground = rows.select(key, normal(F.col("ground")).alias("g"), facts.numbers(F.col("ground")).alias("v"))
    grounded = materialize(mentions(ground, key, "g", names), "grounded")
    general = grounded.join(generals, "canonical").select(key, normal(F.col("general")).alias("phrase"), F.lit(True).alias("general")).distinct()
    terms = materialize(key_terms(rows.select(key, "rewrite"), key, "rewrite", names, ambiguous), "key-terms")
    of_terms = terms.join(names, "phrase").join(grounded, [key, "canonical"]).select(key, "term", F.lit(True).alias("alias")).distinct()
    checked = terms.join(ground, key).join(of_terms, [key, "term"], "left").join(general, [key, "phrase"], "left")
    left = F.regexp_replace("term", "[0-9.-]+", "")
    inside = facts.numbers(F.regexp_replace("term", "[A-Za-z]", " "))
    figures = (F.size(inside) > 0) & F.forall(inside, lambda n: F.exists("v", lambda g: F.abs(n - g) <= F.greatest(F.lit(1e-9), 1e-6 * F.greatest(F.abs(n), F.abs(g)))))
    literal = holds(F.col("g"), F.col("phrase"))
    by_figures = F.col("term").rlike("[0-9]") & figures & holds(F.col("g"), normal(F.when(left == "", F.col("term")).otherwise(left)))
    how = F.when(literal, "literal").when(F.col("alias"), "alias").when(F.col("general"), "general").when(by_figures, "figures").otherwise("none")
    judged = checked.select(key, "term", how.alias("how")).groupBy(key).agg(
        F.count("*").alias("n_terms"), *(F.sum((F.col("how") == k).cast("long")).alias(f"n_{k}") for k in ("literal", "alias", "general")), F.array_join(F.array_sort(F.collect_set(F.when(F.col("how") == "none", F.col("term")))), " ").alias("bad_terms")
    )
    out = numbers.join(judged, key, "left").fillna(0, ["n_terms", "n_literal", "n_alias", "n_general"]).fillna("", ["bad_terms"])
    return out.withColumn("valid", (F.col("n_bad_numbers") == 0) & (F.col("bad_terms") == ""))


def _printed(values: pa.Array) -> pa.Array:
    return pa.array([v and [f"{x:.6f}".rstrip("0").rstrip(".") for x in v] for v in values.to_pylist()], pa.list_(pa.string()))


def number_strings(column: Column) -> Column:
    """Numbers of a text as strings, to six places without trailing zeros. Printed in Python, which gives all digits of a double; Java gives some 17 and then zeros."""
    return F.arrow_udf(_printed, "array<string>")(facts.numbers(column))
