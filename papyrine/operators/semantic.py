"""Vectors of passages against all chunks of documents: nearest chunks, best chunks by document, calibrated scores of matches.

The passages are the stated side. They are sent to the tasks that hold the chunks, so many at a time as ASKED; the chunks
themselves are read where they are and never shuffled. A task keeps the best of each passage and document before anything
is shuffled, so what moves follows passages and documents, not chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.evaluation import quantiles

#: Passages that are sent to tasks at once, and chunks that are compared with them at once.
ASKED, SLICE = 4096, 2048
#: Pairs of a passage and a chunk that a task holds at once: what is kept of them can be as many.
PAIRS = 1 << 19
# The range of cosines that stands for nothing to everything, the share of whole documents, the points.
LOW, HIGH, WHOLE_SHARE, MOST = 0.558, 0.891, 0.6, 55.0
# The least cosine of a related skill, and what is left of it as confidence.
RELATED, DAMPED = 0.65, 0.8


def _units(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of unit length; vectors without length, with nulls or of another width (the longest, if not given) become zeros."""
    rows = [np.zeros(0) if v is None else np.array([np.nan if x is None else x for x in v], np.float64) for v in column.to_pylist()]
    width = max(map(len, rows), default=0) if width is None else width
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        if len(row) == width and np.isfinite(row).all() and (norm := np.sqrt((row * row).sum())) > 0:
            out[i] = row / norm
    return out


def _asked(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """query_id and unit vectors of the passages, ASKED at most at a time."""
    ids, rows = [], []

    def out():
        return np.array(ids, np.int64), _units(pa.array(rows, pa.list_(pa.float64())))

    for query, vector in queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>")).filter("query_id is not null").toLocalIterator():
        ids.append(query)
        rows.append(vector)
        if len(ids) == ASKED:
            yield out()
            ids, rows = [], []
    if ids:
        yield out()


def best_chunks(queries: DataFrame, chunks: DataFrame, k: int = 1, others_only: bool = False) -> DataFrame:
    """query_id, owner, chunk_id, cosine, rank: of each query and owner the k nearest chunks, ties to the smaller chunk_id.

    queries: query_id, embedding; chunks: owner, chunk_id, embedding. Cosines have six digits. Vectors of another length
    than the first, with nulls or without length have a cosine of 0. others_only leaves a query's own id out.
    """
    rows = chunks.select(F.col("owner").cast("long").alias("owner"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("owner is not null and chunk_id is not null")
    schema = "query_id long, owner long, chunk_id long, cosine double"
    found = [rows.mapInArrow(_kept(ids, units, k, others_only), schema) for ids, units in _asked(queries)]
    out = found[0] if found else rows.sparkSession.createDataFrame([], schema)
    for more in found[1:]:
        out = out.unionByName(more)
    order = Window.partitionBy("query_id", "owner").orderBy(F.col("cosine").desc(), "chunk_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def _kept(ids: np.ndarray, units: np.ndarray, k: int, others_only: bool):
    """For mapInArrow: the k best of a slice of a batch for each query and owner. A batch is sorted, so owners' chunks stay together."""
    size = max(1, min(SLICE, PAIRS // max(1, len(ids))))

    def run(batches):
        for batch in batches:
            owners, chunks = (batch.column(c).to_numpy() for c in ("owner", "chunk_id"))
            whole = np.lexsort((chunks, owners))
            for a in range(0, batch.num_rows, size):
                order = whole[a : a + size]
                owner, chunk, vectors = owners[order], chunks[order], _units(batch.column("embedding").take(pa.array(order)), units.shape[1])
                cosine = np.round(units @ vectors.T, 6) + 0.0
                if others_only:
                    cosine[ids[:, None] == chunk[None, :]] = -np.inf
                edges = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(owner))
                out = []
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    at = cosine[:, lo:hi].argmax(axis=1)[:, None] if k == 1 else np.argsort(-cosine[:, lo:hi], axis=1, kind="stable")[:, :k]
                    which = np.repeat(np.arange(len(ids)), at.shape[1])
                    at = at.ravel() + lo
                    good = cosine[which, at] > -np.inf
                    out.append((ids[which[good]], owner[at[good]], chunk[at[good]], cosine[which[good], at[good]]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "owner", "chunk_id", "cosine"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, cosine, rank of each query's k nearest other vectors (chunk_id, embedding)."""
    return best_chunks(queries, vectors.withColumn("owner", F.lit(0)), k, others_only=True).drop("owner")


def cosine_counts(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """cosine (six digits), n: how many pairs of a query (query_id, embedding) and another vector (chunk_id, embedding) have it.

    Tasks count, so what is shuffled are the different cosines of each task, two million at most. Null vectors
    and pairs of vectors of different lengths have no cosine; vectors with nulls or without length have one of 0.
    """
    queries, vectors = queries.filter("embedding is not null"), vectors.filter("embedding is not null")
    schema, size = "cosine double, n long", F.size("embedding")
    found = []
    for (width,) in queries.select(size).distinct().collect():  # the lengths of vectors: one, as a rule
        rows = vectors.filter((size == width) & F.col("chunk_id").isNotNull()).select(F.col("chunk_id").cast("long"), F.col("embedding").cast("array<double>"))
        found += [rows.mapInArrow(_counted(ids, units), schema) for ids, units in _asked(queries.filter(size == width))]
    out = found[0] if found else vectors.sparkSession.createDataFrame([], schema)
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("cosine").agg(F.sum("n").alias("n"))


def _counted(ids: np.ndarray, units: np.ndarray):
    """For mapInArrow: the numbers of a task's cosines by value in millionths."""
    edge = 1_000_100

    def run(batches):
        total = np.zeros(2 * edge + 1, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                others = ids[:, None] != part.column(0).to_numpy()[None, :]
                at = np.rint((units @ _units(part.column(1)).T) * 1e6).astype(np.int64) + edge
                total += np.bincount(at[others], minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((held - edge) / 1e6), pa.array(total[held])], ["cosine", "n"])

    return run


def calibrated(cosine: Column, low, high) -> Column:
    """0 up to low, 1 from high, linear between."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(cosine - low, high - low)))


def fitted_range(cosines: DataFrame) -> DataFrame:
    """low, high: the 5th and 95th percentile of cosines, one row."""
    ends = quantiles(cosines.withColumn("all", F.lit(1)), ["all"], "cosine", {"low": 0.05, "high": 0.95})
    return ends.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def document_similarity(best: DataFrame, asked: DataFrame) -> DataFrame:
    """right, owner, similarity: the mean over a text's chunks of the best cosine in the document.

    best: of best_chunks; asked: query_id, right (the text that the chunk is of).
    """
    return best.filter("rank = 1").join(asked.select("query_id", "right"), "query_id").groupBy("right", "owner").agg(F.round(F.avg("cosine"), 8).alias("similarity"))


def semantic_scores(whole: DataFrame, best: DataFrame, asked: DataFrame, ends: DataFrame, share: float = WHOLE_SHARE, most: float = MOST) -> DataFrame:
    """right, owner, whole, covered, n_asked, score of every posting and document that have a cosine.

    whole: right, owner, cosine of the whole texts; best: of best_chunks, for the postings' requirements; asked: query_id,
    right; ends: low and high, one row. Without requirements, or without chunks in the document, the whole texts count alone.
    """
    parts = best.filter("rank = 1").join(asked.select("query_id", "right"), "query_id").crossJoin(F.broadcast(ends)).withColumn("part", calibrated(F.col("cosine"), F.col("low"), F.col("high")))
    means = parts.groupBy("right", "owner").agg(F.avg("part").alias("part"), F.sum((F.col("part") >= 0.5).cast("long")).alias("covered"), F.count("*").alias("n_asked"))
    both = whole.crossJoin(F.broadcast(ends)).join(means, ["right", "owner"], "left").withColumn("whole", calibrated(F.col("cosine"), F.col("low"), F.col("high")))
    score = F.when(F.col("part").isNull(), F.col("whole")).otherwise(share * F.col("whole") + (1 - share) * F.col("part"))
    zero = F.lit(0).cast("long")
    return both.select("right", "owner", F.round("whole", 6).alias("whole"), F.coalesce("covered", zero).alias("covered"), F.coalesce("n_asked", zero).alias("n_asked"), F.round(most * score, 1).alias("score"))


def related(best: DataFrame, least: float | Column = RELATED) -> DataFrame:
    """query_id, owner, chunk_id, similarity, confidence: for what a document lacks, its nearest other thing if that is near enough."""
    return best.filter((F.col("rank") == 1) & (F.col("cosine") >= least)).select("query_id", "owner", "chunk_id", F.round("cosine", 4).alias("similarity"), F.round(DAMPED * F.round("cosine", 4), 2).alias("confidence"))
