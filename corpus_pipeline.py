"""documents, cleaned, deduplicated, mixed and packed. Each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyrine.llm import quality_rules
from papyrine.llm.mixing import mixed_documents
from papyrine.llm.ngram_join import one_of_each
from papyrine.llm.packing import pack_documents
from papyrine.llm.toxicity import drop_toxic
from papyrine.storage import materialize
from papyrine.tables import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep; null and short texts go, and an empty table stays empty."""
    return quality_rules.keep_good(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold of toxicity; the model learns from labels of the documents that are left."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; rows without a doc_id stay."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: up to three times, or not at all."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences; a repeated row has pieces of its own."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", keep_good), ("toxicity", keep_clean), ("ngram_jaccard_join", keep_one_of_each), ("mixing", mix), ("packing", pack)]

#: Training and tokenizing can't be told in SQL; a test holds run() against plain Python on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
