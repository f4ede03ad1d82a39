"""How far the sources of a language are apart in their words, by sparse merges of sorted (term id, count) arrays.

Terms are counted in tasks, per language and source. The terms that a language keeps are numbered in blocks, so a source's
counts are sorted arrays of bounded length. Sources fall into tiles; for two tiles (or one and itself) and a block of terms,
one task has the arrays of both and merges each unordered pair: the shorter array is looked up in the longer one, terms of
both, of one side only, and of neither are priced, and the sum holds both ways round.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.terms import LETTERS, terms
from papyrine.storage import materialize

#: Documents of a language that must hold a term; what is added to counts; the whole that prices are parts of.
LEAST, ADDED, WHOLE = 30, 5, 1_000_000_000
#: Terms of a block, sources of a tile, on average.
BLOCK, TILE = 1024, 16
#: Entries of a task's counts until they are passed on.
ENTRIES = 400_000


def audit(docs: DataFrame, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: the distance to each other source of the language. Part `term`: the top terms that the source has more of
    than its language. Nulls and empty texts give groups without terms, whose prices are all alike; a language that keeps no
    term has distances of 0. Repeated rows count as often as they occur; other columns are ignored; no rows give none.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counts = docs.select(*text).mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    # By language and term, so that the totals of the language need no further shuffle.
    summed = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    known = summed.withColumns({"lang_n": F.sum("n").over(whole), "lang_docs": F.sum("docs").over(whole)})
    # The empty term stands for the group itself, so that groups without terms stay.
    kept = materialize(known.filter((F.col("lang_docs") >= LEAST) | (F.col("term") == "")).drop("docs", "lang_docs"), "divergence-kept")
    terms_of = kept.filter("term <> ''")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("total").alias("lang_total"))
    sizes = terms_of.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    langs = langs.join(sizes, "lang", "left").na.fill(0, ["v"])
    langs = langs.withColumns({"blocks": F.ceil(F.greatest(F.col("v"), F.lit(1)) / BLOCK), "tiles": F.ceil(F.col("sources") / TILE)})
    groups = materialize(groups.join(langs, "lang"), "divergence-groups")
    return _pairs(terms_of, groups).unionByName(_terms(terms_of, groups, top))


def _counts(batches):
    """Occurrences, and documents that hold them, by language, source and term; one row with an empty term a group."""
    found: dict = defaultdict(lambda: (Counter(), Counter()))

    def out():
        for (lang, source), (n, docs) in found.items():
            names = [t.decode("utf-8", "replace") for t in n]
            size = len(names) + 1
            columns = [pa.array([lang] * size), pa.array([source] * size), pa.array(["", *names]), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        found.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
            n, docs = found[lang, source]
            held = set()
            for part in terms(text.as_py(), LETTERS):
                n.update(part)
                held.update(part)
            docs.update(held)
        if sum(len(n) for n, _ in found.values()) >= ENTRIES:
            yield from out()
    yield from out()


def price(n: Column, total: Column, v: Column) -> Column:
    """The share of a count, smoothed, in parts of WHOLE."""
    return 1 + F.call_function("div", F.lit(WHOLE).cast("decimal(10,0)") * (n + ADDED).cast("decimal(20,0)"), (total + ADDED * v).cast("decimal(20,0)"))


def _terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    rows = kept.join(groups.select("lang", "source", "total", "lang_total", "v"), ["lang", "source"])
    p, q = price(F.col("n"), F.col("total"), F.col("v")), price(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    over = rows.filter("n > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    placed = kept.join(groups.select("lang", "source", "blocks"), ["lang", "source"]).select("lang", "source", "term", "n", block.alias("block"))
    numbered = placed.withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "block").orderBy("term")))
    arrays = numbered.groupBy("lang", "block", "source").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("held"))
    # Every source of a language has a row in every block, or else its terms that only others have would not be priced.
    every = groups.select("lang", "source", "total", "v", "tiles", F.pmod(F.xxhash64("source", F.lit("tile")), F.col("tiles")).alias("tile"), F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"))
    rows = every.join(arrays, ["lang", "block", "source"], "left")
    low = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j")))
    sent = rows.withColumn("to", F.explode(low)).select(
        "lang", "block", "to.i", "to.j", "source", "tile", "total", "v",
        F.coalesce(F.transform("held", lambda h: h["id"]), F.array().cast("array<int>")).alias("ids"), F.coalesce(F.transform("held", lambda h: h["n"]), F.array().cast("array<long>")).alias("ns"),
    )
    merged = sent.groupBy("lang", "block", "i", "j").applyInArrow(_merged, "lang string, a string, b string, v long, value decimal(38,0), seen long, absent long")
    summed = merged.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("v").alias("v"), F.max("absent").alias("absent"))
    value = (F.col("value") + (F.col("v") - F.col("seen")) * F.col("absent")).cast("long")
    both = summed.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), value.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(order))


def prices(ns: np.ndarray, total: int, v: int) -> np.ndarray:
    """As price(), of an array; whole numbers of any size."""
    if not total + ADDED * v:
        return np.zeros(len(ns), np.int64)
    if len(ns) and int(ns.max()) + ADDED >= (1 << 63) // WHOLE:
        return np.array([1 + WHOLE * (int(n) + ADDED) // (total + ADDED * v) for n in ns], np.int64)
    return 1 + WHOLE * (ns + ADDED) // (total + ADDED * v)


def distance(a: tuple, b: tuple) -> tuple[int, int]:
    """The sum of the differences of two sources' prices over the terms that either has, and the number of these.

    a, b: sorted ids, their prices, and the price of a term that the source doesn't have.
    """
    (few, fp, f0), (many, mp, m0) = sorted((a, b), key=lambda x: len(x[0]))
    if not len(many):
        return 0, 0
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    hit = many[at] == few
    both = int(np.abs(fp[hit] - mp[at[hit]]).sum())
    left = int(np.abs(fp[~hit] - m0).sum())
    right = int(np.abs(mp - f0).sum()) - int(np.abs(mp[at[hit]] - f0).sum())
    return both + left + right, len(few) + len(many) - int(hit.sum())


def _merged(key: tuple, rows: pa.Table) -> pa.Table:
    lang, _, i, j = (k.as_py() for k in key)
    sides: dict[int, list] = {i: [], j: []}
    v = 0
    for row in range(rows.num_rows):
        source, tile, total, v = (rows.column(c)[row].as_py() for c in ("source", "tile", "total", "v"))
        ids, ns = (rows.column(c)[row].values.to_numpy() for c in ("ids", "ns"))
        none = int(prices(np.zeros(1, np.int64), total, v)[0])
        sides[tile].append((source, (ids, prices(ns, total, v), none)))
    out: list = []
    for x, (a, one) in enumerate(sides[i]):
        for b, other in sides[j] if i != j else sides[i][x + 1 :]:
            value, seen = distance(one, other)
            # Rows of a tile come in any order, but all blocks must name a pair alike, or its parts aren't added up.
            out.append((lang, *sorted((a, b)), v, value, seen, abs(one[2] - other[2])))
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.decimal128(38, 0), pa.int64(), pa.int64()]
    names = ["lang", "a", "b", "v", "value", "seen", "absent"]
    return pa.table([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], names=names)
