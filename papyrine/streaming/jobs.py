"""Grading documents as they arrive, and a queue of jobs worked through in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyrine.operators import statements


def graded_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Graded statements of documents (doc_id, text) that are added to a folder. Stateless, as all its parts are."""
    docs = spark.readStream.schema(schema).parquet(path)
    return statements.graded(statements.statements(docs, "doc_id"))


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def event_counts(spark: SparkSession, path: str, schema: str, late: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """Events by type in windows of event time; what comes later than late is left out."""
    events = spark.readStream.schema(schema).parquet(path)
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def run_jobs(spark: SparkSession, path: str, schema: str, handlers: dict[str, Callable[[DataFrame], DataFrame]], out: str, checkpoint: str) -> StreamingQuery:
    """Works through jobs (job_id, kind, created, payload) by creation: each kind's handler gets its jobs of a batch.

    Jobs of unknown kinds fail. out gets job_id, kind, status, result and place in the queue, once per job and batch: a
    batch that is repeated after a failure overwrites its own folder.
    """

    def work(batch: DataFrame, number: int) -> None:
        order = Window.partitionBy("kind").orderBy("created", "job_id")
        queued = batch.withColumn("place", F.row_number().over(order))
        done = [handler(queued.filter(F.col("kind") == kind)).select("job_id", "kind", F.lit("done").alias("status"), F.col("result").cast("string").alias("result"), "place") for kind, handler in handlers.items()]
        failed = queued.filter(~F.col("kind").isin(*handlers) | F.col("kind").isNull()).select("job_id", "kind", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("result"), "place")
        for part in done:
            failed = failed.unionByName(part)
        failed.write.mode("overwrite").parquet(f"{out}/batch={number}")

    jobs = spark.readStream.schema(schema).parquet(path)
    return jobs.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
