"""Ranked lexical search of a set of items in all documents, by frequency-ordered tries with branch and bound.

A document is cut down to the items' terms, and its vector of (term, tf) is put in order of falling document frequency.
A task takes its documents in blocks. Sorted vectors that begin alike lie side by side, so a trie node is a run of them;
it holds the largest tf of every term and the least length measure m below it. A term's part of the score grows with tf and
falls with m, so these bound every score below the node. For each item the trie is walked depth first, the best child first,
and a node whose bound is under the item's 50th score so far is left. Nothing else is left out, so the results are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.terms import WORDY, terms
from papyrine.storage import materialize

#: Parts of the length measure and of the saturation.
FLAT, SLOPE, PART = 50, 50, 20
#: Runs of so many documents aren't split further.
LEAF = 32
#: Levels below which nodes are cut in halves.
DEEP = 200
#: Cells (documents by terms) of a block; four bytes each.
CELLS = 1 << 23
#: Documents of a block at most.
BLOCK = 1 << 14
#: Item terms that are searched in one pass over the documents.
AT_ONCE = 1 << 17
#: Groups in which the best rows of tasks are ranked before all groups are.
GROUPS = 64


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, ties to the smaller doc_id.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Null and empty texts have no terms: such documents
    count nowhere and such items get no rows. Rows with the same item_id are one item. Rows of docs with the same doc_id are
    documents of their own; a null doc_id comes after all others among equal scores. The items' terms go to every task, in
    passes of about AT_ONCE terms, so memory doesn't follow the number of items.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = materialize(_item_terms(items), "trie-items")
    found = [_search(texts, part, k) for part in _passes(asked)]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for keys in (["item_id", "part"], ["item_id"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return rows.select("item_id", "rank", "doc_id", "score")


def _item_terms(items: DataFrame) -> DataFrame:
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(words).alias("term")).distinct()


def _passes(asked: DataFrame) -> Iterator[dict[int | None, list[bytes]]]:
    """The items with their terms, so many at a time that they fit into every task."""
    passes = -(-asked.count() // AT_ONCE)
    for p in range(passes):
        chosen = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p) if passes > 1 else asked
        found: dict[int | None, list[bytes]] = {}
        for item, term in chosen.toLocalIterator():
            found.setdefault(item, []).append(term.encode())
        if found:
            yield found


def _search(texts: DataFrame, items: dict[int | None, list[bytes]], k: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for ts in items.values() for t in ts}))}
    vectors = materialize(texts.mapInArrow(_restricted(vocabulary), "doc_id long, n long, ids array<int>, tfs array<long>"), "trie-vectors")
    n_docs, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for i, held in vectors.select(F.explode("ids").alias("i")).groupBy("i").count().collect():  # a row for each term of the pass
        df[i] = held
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    order = np.lexsort((np.arange(len(df)), -df))  # frequent terms first
    place = np.empty(len(df), np.int64)
    place[order] = np.arange(len(df))
    wanted = [(item, np.sort(place[[vocabulary[t] for t in ts if df[vocabulary[t]]]])) for item, ts in items.items()]
    wanted = [(item, ts[weight[order][ts] > 0]) for item, ts in wanted]
    wanted = [(item, ts) for item, ts in wanted if len(ts)]
    run = _ranked(wanted, weight[order], place, n_docs, length, k)
    return vectors.filter(F.size("ids") > 0).mapInArrow(run, "item_id long, doc_id long, score long, part int")


def _restricted(vocabulary: dict[bytes, int]):
    """For mapInArrow: documents that have terms, with their number and those that an item has."""

    def run(batches):
        for batch in batches:
            ids, ns, held, tfs = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, counts = 0, Counter()
                for part in terms(text.as_py(), WORDY):
                    n += len(part)
                    counts.update(filter(vocabulary.__contains__, part))
                if n:
                    ids.append(doc)
                    ns.append(n)
                    held.append([vocabulary[t] for t in counts])
                    tfs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "ids", "tfs"])

    return run


def measure(n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """The length measure m of documents with n terms each."""
    if len(n) and int(n.max()) * n_docs * SLOPE >= 1 << 63:
        return np.array([100 - FLAT + SLOPE * int(x) * n_docs // length for x in n], np.int64)
    return 100 - FLAT + SLOPE * n * n_docs // length


def saturated(tf, m):
    """The part of a score that a term has by its frequency, before it is weighed."""
    return 1_000_000_000 * tf // (1000 * tf + PART * m)


class Trie:
    """A block of documents: runs of sorted vectors as nodes, with tf maxima by term and the least m."""

    def __init__(self, ids: list, m: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        spelt = [v.astype(">i4").tobytes() for v, _ in vectors]
        order = sorted(range(len(ids)), key=spelt.__getitem__)
        self.ids = np.array([-1 if ids[i] is None else ids[i] for i in order], np.int64)
        self.null = np.array([ids[i] is None for i in order], bool)
        self.m = m[order]
        self.spelt = [spelt[i] for i in order]
        self.parts = np.zeros((len(order), n_terms), np.float32)  # under 2**20, so whole numbers stay exact
        self.nodes: list[tuple[int, int, list[int]]] = []
        tops, least = [], []
        tf = np.zeros((LEAF, n_terms), np.int64)
        for row, i in enumerate(order):
            at, count = vectors[i]
            self.parts[row, at] = saturated(count, self.m[row])

        def add(lo: int, hi: int, depth: int, level: int = 0) -> int:
            children = [add(*run, level + 1) for run in self._runs(lo, hi, depth, level)] if hi - lo > LEAF else []
            if children:
                top, low = np.max([tops[c] for c in children], axis=0), min(least[c] for c in children)
            elif hi - lo <= LEAF:
                tf[: hi - lo] = 0
                for row in range(lo, hi):
                    at, count = vectors[order[row]]
                    tf[row - lo, at] = count
                top, low = tf[: hi - lo].max(axis=0), self.m[lo:hi].min()
            else:  # many documents with one and the same vector of terms
                top, low = np.zeros(n_terms, np.int64), self.m[lo:hi].min()
                for row in range(lo, hi):
                    at, count = vectors[order[row]]
                    top[at] = np.maximum(top[at], count)
            tops.append(top)
            least.append(int(low))
            self.nodes.append((lo, hi, children))
            return len(self.nodes) - 1

        self.root = add(0, len(order), 0)
        self.top, self.least = np.array(tops), np.array(least, np.int64)

    def _runs(self, lo: int, hi: int, depth: int, level: int) -> list[tuple[int, int, int]]:
        """The children of a node: runs that share the term at the first depth where the node's vectors part; small ones together.

        A trie that gets deep, as with vectors that each add one term to another, is cut in halves from there on.
        """
        first, last = self.spelt[lo], self.spelt[hi - 1]
        size = min(len(first), len(last)) // 4
        while depth < size and first[4 * depth : 4 * depth + 4] == last[4 * depth : 4 * depth + 4]:
            depth += 1
        if first == last:
            return []
        if level >= DEEP:
            return [(lo, (lo + hi) // 2, depth), ((lo + hi) // 2, hi, depth)]
        runs, begin = [], lo
        for row in range(lo + 1, hi + 1):
            if row == hi or self.spelt[row][4 * depth : 4 * depth + 4] != self.spelt[begin][4 * depth : 4 * depth + 4]:
                if runs and row - runs[-1][0] <= LEAF:
                    runs[-1] = (runs[-1][0], row, depth)
                else:
                    runs.append((begin, row, depth + (row - begin > LEAF)))
                begin = row
        return runs if len(runs) > 1 else [(lo, (lo + hi) // 2, depth), ((lo + hi) // 2, hi, depth)]


def _ranked(items: list[tuple[int | None, np.ndarray]], weight: np.ndarray, place: np.ndarray, n_docs: int, length: int, k: int):
    """For mapInArrow: of all documents of a task each item's k best."""
    n_terms = len(weight)
    block = min(BLOCK, max(4 * LEAF, CELLS // max(n_terms, 1)))

    def walk(trie: Trie, bounds: np.ndarray, ts: np.ndarray, best: tuple) -> tuple:
        ws, stack = weight[ts].astype(np.float64), [trie.root]
        while stack:
            node = stack.pop()
            floor = best[0][-1] if len(best[0]) == k else 1
            if bounds[node] < floor:
                continue
            lo, hi, children = trie.nodes[node]
            if children:
                stack.extend(sorted(children, key=bounds.__getitem__))
                continue
            scores = (trie.parts[lo:hi, ts].astype(np.float64) @ ws).astype(np.int64)  # whole numbers below 2**53
            good = np.flatnonzero(scores >= floor)
            if len(good):
                joined = [np.concatenate(x) for x in zip(best, (scores[good], trie.null[lo:hi][good], trie.ids[lo:hi][good]), strict=True)]
                kept = np.lexsort((joined[2], joined[1], -joined[0]))[:k]
                best = tuple(x[kept] for x in joined)
        return best

    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items]

        def look(rows: list) -> None:
            trie = Trie([r[0] for r in rows], measure(np.array([r[1] for r in rows], np.int64), n_docs, length), [r[2] for r in rows], n_terms)
            limits = saturated(trie.top, trie.least[:, None]) * weight
            for i, (_, ts) in enumerate(items):
                best[i] = walk(trie, limits[:, ts].sum(axis=1), ts, best[i])

        rows: list = []
        for batch in batches:
            columns = [batch.column(c) for c in ("doc_id", "n", "ids", "tfs")]
            for doc, n, ids, tfs in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], columns[3], strict=True):
                at = place[ids.values.to_numpy()]
                order = np.argsort(at)
                rows.append((doc, n, (at[order], tfs.values.to_numpy()[order])))
                if len(rows) == block:
                    look(rows)
                    rows = []
        if rows:
            look(rows)
        for (item, _), (scores, null, ids) in zip(items, best, strict=True):
            if len(scores):
                part = np.full(len(ids), abs(int(ids[0])) % GROUPS, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(scores), pa.array(part)], ["item_id", "doc_id", "score", "part"])

    return run
