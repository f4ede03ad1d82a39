"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.storage import materialize


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out, per_class: int) -> DataFrame:
    """doc_id, text, y of up to per_class documents of either label (0, 1), chosen by a hash of doc_id.

    held_out is a condition on doc_id; rows where it holds are left out. Labels that are null or neither 0 nor 1 are
    ignored; of conflicting labels of a document the greatest counts, and of repeated rows of a document the text that
    is least by hash, so there are at most 2 * per_class rows. As many labels are broadcast.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max(label).alias("y"))
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = materialize(parts[0].union(parts[1]), "labelled-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return materialize(found.select("doc_id", "text", "y"), "labelled-texts")


def crc_remainder(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))
