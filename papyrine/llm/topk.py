"""Exact top-k search by inner product, with sorted lists that are only read from their ends (no random access).

Vectors fall into blocks by a hash of their id, queries into blocks as well; each pair of blocks is a task of bounded
size. In a block every dimension has a list of the vectors in order of that component. For a query the lists are read
from the end that gives the larger products, an eighth of them first and twice as far each time. What has been read of a
vector bounds its score: from below with the least products of the unread lists, from above with the products the lists
have come to. When the k-th largest lower bound is above every other vector's upper bound, outsiders can't qualify, and
the lists are only read on for the vectors that are left, until their sums are complete. Where bounds never part, as with
vectors spread alike in all directions, the lists are read to their ends, which completes all sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.storage import materialize

BLOCK = 4096
QUERY_BLOCK = 512
SCALE = 1024
#: The first depth is this part of a list.
FIRST = 8
_LONG = 2**63


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double); vectors that are null or hold null or non-finite components go.

    An empty vector takes part; of vectors of unequal length, missing components are 0. Of rows with one vec_id the least
    vector counts.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(finite).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("v"))


def _quantized(vectors: pd.Series, width: int) -> np.ndarray:
    """floor(SCALE * x) of every component: exact as a double, since SCALE is a power of two."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * SCALE)


def read_lists(q: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
    """For each row of q: the rows of x that can be among the k largest, their scores, and two shares of list entries.

    The shares are how much of the lists had been read when outsiders couldn't qualify, and how much when the sums of
    those that are left were complete. All queries read to the same depths; entries that they read from the same end are
    summed for all of them by a product of what is new at a depth. Ties at the k-th place stay.
    """
    n, width = x.shape
    order = np.argsort(x, axis=0, kind="stable")
    rank = np.empty(x.shape, np.int64)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], x.shape), axis=0)
    dims = np.arange(width)
    # Upper ends go with the positive parts of the queries, lower ends with the negative ones.
    place = np.concatenate((n - 1 - rank, rank), axis=1)
    values = np.concatenate((x, x), axis=1)
    both = np.concatenate((np.maximum(q, 0), np.minimum(q, 0)), axis=1).T
    least = both * np.concatenate((x[order[0], dims], x[order[-1], dims]))[:, None]
    known, unread = np.zeros((n, len(q)), x.dtype), np.repeat(least.sum(axis=0)[None], n, axis=0)
    out: list = [None] * len(q)
    stopped: dict[int, tuple[np.ndarray, float]] = {}
    asking, read, depth = np.arange(len(q)), 0, max(1, -(-n // FIRST))
    while len(asking):
        depth = min(depth, n)
        new = ((place >= read) & (place < depth)).astype(x.dtype)
        known[:, asking] += (new * values) @ both[:, asking]
        unread[:, asking] -= new @ least[:, asking]
        if depth < n:
            seen = (place < depth).astype(x.dtype)
            frontier = both * np.concatenate((x[order[n - depth], dims], x[order[depth - 1], dims]))[:, None]
            upper = known[:, asking] + frontier[:, asking].sum(axis=0) - seen @ frontier[:, asking]
            lower = known[:, asking] + unread[:, asking]
            enough = np.sort(lower, axis=0)[max(0, n - k)] if n > k else lower.min(axis=0)
            possible = upper >= enough
        else:
            scores = known[:, asking]
            possible = scores >= (np.sort(scores, axis=0)[n - k] if n > k else scores.min(axis=0))
        done = []
        for j, i in enumerate(asking):
            if i not in stopped and (depth == n or possible[:, j].sum() <= k):
                stopped[i] = np.flatnonzero(possible[:, j]), depth / n
            if i in stopped:
                left, share = stopped[i]
                asked = both[:, i] != 0
                if depth == n or (place[left][:, asked] < depth).all():
                    out[i] = left, known[left, i], share, depth / n
                    done.append(j)
        asking = np.delete(asking, done)
        read, depth = depth, 2 * depth
    return out


def _search(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    names = {"query_id": "int64", "vec_id": "int64", "score": "int64", "stop_share": "float64", "read_share": "float64"}
    if not len(vectors) or not len(queries):
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in names.items()})
    vectors = vectors.assign(t=vectors.v.map(tuple)).sort_values(["vec_id", "t"]).drop_duplicates("vec_id")
    width = max(1, max(map(len, vectors.v)), max(map(len, queries.q)))
    x, q, ids = _quantized(vectors.v, width), _quantized(queries.q, width), vectors.vec_id.to_numpy()
    # Doubles are exact while sums of products stay below 2**53; beyond that whole numbers of any size are summed.
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * width >= 2**53:
        x, q = (np.array([[int(c) for c in row] for row in a], dtype=object).reshape(a.shape) for a in (x, q))
    out = []
    for own, (left, score, stop, read) in zip(queries.query_id.to_numpy(), read_lists(q, x, k + 1), strict=True):
        others = ids[left] != own
        left, score = left[others], score[others]
        best = sorted(range(len(left)), key=lambda i: (-score[i], ids[left[i]]))[:k]
        whole = np.array([min(max(int(score[i]), -_LONG), _LONG - 1) for i in best], np.int64)
        out.append((np.full(len(best), own), ids[left[best]], whole, np.full(len(best), stop), np.full(len(best), read)))
    return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)))


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score, stop_share, read_share: the k other vectors with the largest products, ties to the smaller vec_id.

    vectors: vec_id, embedding. is_query: a condition on vec_id. Scores are exact; one beyond a long counts as the nearest
    long. stop_share and read_share tell how much of the lists of the result's block had been read when outsiders couldn't
    qualify, and in all. Without vectors or queries the result is empty; queries with fewer than k others get all. Other
    columns are ignored.
    """
    rows = materialize(usable(vectors), "topk-vectors")
    # Its own names: columns of one origin on both sides of a cogroup are mistaken for each other.
    queries = rows.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    total, asked = rows.count(), max(1, queries.count())
    blocks, query_blocks = max(1, -(-total // BLOCK)), -(-asked // QUERY_BLOCK)
    # Either side is repeated for each block of the other: a set of queries against all rows, in blocks.
    side = rows.withColumns({"_block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), "_asked": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))})
    other = queries.withColumns({"_asked": F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(query_blocks)).cast("int"), "_block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
    found = side.groupBy("_block", "_asked").cogroup(other.groupBy("_block", "_asked")).applyInPandas(lambda a, b: _search(a, b, k), "query_id long, vec_id long, score long, stop_share double, read_share double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "stop_share", "read_share")
