"""Pages of placed pieces of text: gutters between columns, reading order, rows of pieces, and flags of the layout.

pieces: doc_id, page, piece (an id in the page), x0, y0, x1, y1, text, size, bold, width (of the page). A page is one group: its
pieces are what a page holds. Pieces without width (x1 <= x0) are left out where gutters are looked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import text_of
from papyrine.operators.entries import BULLET

# Pieces that a page with columns has at least, and each side of the gutter; where it may be, in shares of the
# width, and in what steps; how many pieces may cross it; how much larger headings of columns are; how close rows are.
LEAST, SIDE, FROM, TO, STEP, CROSSING, CROSSING_SHARE, HEAD, CLOSE = 16, 8, 0.3, 0.7, 2, 2, 0.06, 1.25, 2.5
#: How sure the order is, with columns and without.
SURE = (0.75, 1.0)
PAGE = ["doc_id", "page"]


def _gathered(pieces: DataFrame, *keys: str) -> DataFrame:
    """keys and p, the pieces of a page (or of a region of it) as one array, in any order."""
    return pieces.groupBy(*keys).agg(F.collect_list(F.struct(*(c for c in pieces.columns if c not in keys))).alias("p"))


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _nulls_first(values: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(values), -np.inf, values)


def _gutters(page: np.ndarray, n_pages: int, x0: np.ndarray, x1: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gutter (NaN: none) and crossing pieces of each page; page: the number of each piece's page.

    Each piece adds one to the first place that has it on its left and to the first that hasn't it on its right any more; sums
    along the places give both sides. Nothing changes between such places, so only these and the first are looked at.
    """
    wide = (x1 > x0) & ~np.isnan(width)
    page, x0, x1 = page[wide], x0[wide], x1[wide]
    size, n = np.full(n_pages, -1.0), np.bincount(page, minlength=n_pages)
    np.maximum.at(size, page, width[wide])
    begin = np.floor(size * FROM)
    places = np.where((n >= LEAST) & (size > 0), np.ceil((np.floor(size * TO) - begin) / STEP), 0)
    right = np.clip(np.ceil((x1 - begin[page]) / STEP), 0, places[page])
    left = np.clip(np.floor((x0 - begin[page]) / STEP), -1, places[page] - 1) + 1
    none = np.zeros(n_pages)
    at, own = np.concatenate([right, left, none]), np.concatenate([page, page, np.arange(n_pages)])
    order = np.lexsort((at, own))
    at, own = at[order], own[order]
    begun, ended = (np.cumsum(np.concatenate(c)[order]) for c in ([np.ones(len(page)), np.zeros(len(page)), none], [np.zeros(len(page)), np.ones(len(page)), none]))
    last = np.append((own[1:] != own[:-1]) | (at[1:] != at[:-1]), True)
    at, own = at[last], own[last]
    before = (np.cumsum(n) - n)[own]
    l, crossing = begun[last] - before, ended[last] - begun[last]
    r = n[own] - (ended[last] - before)
    good = (at < places[own]) & (l >= SIDE) & (r >= SIDE) & (crossing <= np.maximum(CROSSING, CROSSING_SHARE * n[own]))
    at, own, crossing, cost = at[good], own[good], crossing[good], (10 * crossing - np.minimum(l, r))[good]
    order = np.lexsort((at, cost, own))
    pages, first = np.unique(own[order], return_index=True)
    best = order[first]
    gutter, crossed = np.full(n_pages, np.nan), np.zeros(n_pages)
    gutter[pages], crossed[pages] = begin[pages] + STEP * at[best], crossing[best]
    return gutter, crossed


def _regions(page: np.ndarray, starts: np.ndarray, lengths: np.ndarray, gutter: np.ndarray, piece: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, size: np.ndarray, bold: np.ndarray) -> np.ndarray:
    """Region of each piece; columns begin at the first large bold piece below what crosses the gutter, or where that ends."""
    own = gutter[page]
    crosses = (x0 < own) & (own < x1)
    median = size[np.lexsort((piece, _nulls_first(size), page))][starts + lengths // 2]
    band = np.nan_to_num(np.fmax.reduceat(np.where(crosses, y1, np.nan), starts), nan=0.0)
    head = ~crosses & (size >= HEAD * median[page]) & bold & (y0 >= band[page] - 1)
    start = np.fmin.reduceat(np.where(head, y0, np.nan), starts) - 1
    start = np.where(np.isnan(start), band, start)
    return np.where(np.isnan(own) | (y0 < start[page]), 0, np.where(x1 <= own + 1, 1, 2))


def _rows(page: np.ndarray, region: np.ndarray, piece: np.ndarray, x0: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Row of each piece in its region: rows follow from one another, so this is a walk along the pieces."""
    y = (y0 + y1) / 2
    order = np.lexsort((piece, _nulls_first(x0), _nulls_first(np.rint(y)), region, page))
    new = np.append(True, (page[order][1:] != page[order][:-1]) | (region[order][1:] != region[order][:-1]))[: len(order)]
    out, row, first = [], 0, 0.0
    for middle, begins in zip(y[order].tolist(), new.tolist(), strict=True):
        if begins:
            row, first = 0, middle
        elif abs(first - middle) > CLOSE:
            row, first = row + 1, middle
        out.append(row)
    rows = np.empty(len(out), "int32")
    rows[order] = out
    return rows


def _lists(like: pa.Array, values: np.ndarray) -> pa.Array:
    """Values of pieces as one list for each page."""
    ends = np.append(0, np.cumsum(pc.list_value_length(like).to_numpy(zero_copy_only=False))).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype("int32")))


def _laid(piece: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array, size: pa.Array, bold: pa.Array, width: pa.Array) -> pa.Array:
    lengths = pc.list_value_length(piece).to_numpy(zero_copy_only=False)
    page, starts = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
    ids, a, b, c, d, s, w = map(_flat, (piece, x0, y0, x1, y1, size, width))
    gutter, crossing = _gutters(page, len(lengths), a, c, w)
    region = _regions(page, starts, lengths, gutter, ids, a, b, c, d, s, pc.fill_null(bold.flatten(), False).to_numpy(zero_copy_only=False))
    row = _rows(page, region, ids, a, b, d)
    none = np.isnan(gutter)
    return pa.StructArray.from_arrays([pa.array(gutter, mask=none), pa.array(crossing.astype("int64"), mask=none), _lists(piece, region), _lists(piece, row)], ["gutter", "crossing", "region", "row"])


def _folded(piece: pa.Array, x0: pa.Array, y0: pa.Array, y1: pa.Array) -> pa.Array:
    lengths = pc.list_value_length(piece).to_numpy(zero_copy_only=False)
    region = np.repeat(np.arange(len(lengths)), lengths)
    return _lists(piece, _rows(region, region, *map(_flat, (piece, x0, y0, y1))))


_LAID = "struct<gutter:double,crossing:bigint,region:array<int>,row:array<int>>"


def _fields(*names: str) -> list[Column]:
    return [F.col("p")[n].cast("array<bigint>" if n == "piece" else "array<boolean>" if n == "bold" else "array<double>") for n in names]


def _pages(pieces: DataFrame) -> DataFrame:
    """doc_id, page, p, laid: the pieces of a page with its gutter and their regions and rows."""
    lay = F.arrow_udf(_laid, _LAID)
    return _gathered(pieces, *PAGE).withColumn("laid", lay(*_fields("piece", "x0", "y0", "x1", "y1", "size", "bold", "width")))


def gutters(pieces: DataFrame) -> DataFrame:
    """doc_id, page, gutter, crossing: where the fewest pieces cross and the smaller side is largest, of pages that have one."""
    return _pages(pieces).select(*PAGE, "laid.gutter", "laid.crossing").filter("gutter is not null")


def laid(pieces: DataFrame, tasks: int | None = None) -> DataFrame:
    """pieces with gutter (or null), region: 0 above the columns or without any, 1 left, 2 right, and row, as in_rows() gives.

    A page is gathered once; tasks work out the pages of a batch together. tasks: deals whole pages to so many, by document,
    so that what is grouped by document or page afterwards is where it is needed.
    """
    whole = _pages(pieces)
    whole = whole if tasks is None else whole.repartition(tasks, "doc_id")
    zipped = F.arrays_zip(F.col("p"), F.col("laid.region").alias("region"), F.col("laid.row").alias("row"))
    each = whole.select(*PAGE, F.col("laid.gutter").alias("gutter"), F.explode(zipped).alias("x"))
    kept = [F.col(c) if c in PAGE else F.col("x")["p"][c].alias(c) for c in pieces.columns]
    return each.select(*kept, "gutter", F.col("x")["region"].alias("region"), F.col("x")["row"].cast("long").alias("row"))


def regions(pieces: DataFrame) -> DataFrame:
    """pieces with gutter (or null) and region: 0 above the columns or without any, 1 left, 2 right."""
    return laid(pieces).drop("row")


def in_rows(placed: DataFrame) -> DataFrame:
    """pieces of regions() with row, from 0 in each region: a piece begins a row if it is more than CLOSE from the row's first.

    The order is by whole points of the middle, then from the left.
    """
    keys = [*PAGE, "region"]
    fold = F.arrow_udf(_folded, "array<int>")
    each = _gathered(placed, *keys).withColumn("rows", fold(*_fields("piece", "x0", "y0", "y1"))).select(*keys, F.explode(F.arrays_zip("p", "rows")).alias("x"))
    return each.select(*(F.col(c) if c in keys else F.col("x")["p"][c].alias(c) for c in placed.columns), F.col("x")["rows"].cast("long").alias("row"))


def rows(placed: DataFrame) -> DataFrame:
    """doc_id, page, line, x0, y0, x1, y1, text, size, bold, first_bold, is_bullet: rows of pages in reading order.

    line counts a document's rows from 0. Texts are joined from the left, white space is made one space, and taken away
    before signs. bold is the share of characters; the size is that of the longest piece, the left one of equals.
    """
    length = F.length(F.btrim(text_of(F.col("text")), F.lit(" \t\r\n")))
    piece = F.struct(F.col("x0").alias("x"), "piece", F.btrim(text_of(F.col("text")), F.lit(" \t\r\n")).alias("t"), "size", "bold")
    held = placed.groupBy(*PAGE, "region", "row").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sort_array(F.collect_list(piece)).alias("p"),
        F.sum(length).alias("n"), F.sum(F.when(F.col("bold"), length).otherwise(0)).alias("b"),
    )
    joined = F.btrim(F.regexp_replace(F.array_join(F.transform("p", lambda x: x["t"]), "  "), r"\s{2,}|[^\S ]", " "))
    text = F.regexp_replace(joined, r"\s+([,.;:])", "$1")
    longest = F.array_max(F.transform("p", lambda x, i: F.struct(F.length(x["t"]).alias("n"), (-i).alias("i"), x["size"].alias("size"))))["size"]
    first = F.get(F.filter("p", lambda x: (x["t"] != "") & ~x["t"].rlike("^[•●▪■◦‣⁃►▶➢➤→*·○◆◇❖✓✔➔»▫◾-]+$")), F.lit(0))["bold"]
    order = Window.partitionBy("doc_id").orderBy("page", "region", "row")
    out = held.withColumns({"text": text, "size": longest, "bold": F.round(F.col("b") / F.greatest("n", F.lit(1)), 2), "first_bold": F.coalesce(first, F.lit(False)), "line": F.row_number().over(order) - 1})
    return out.select(*PAGE, F.col("line").cast("long").alias("line"), "x0", "y0", "x1", "y1", "text", "size", "bold", "first_bold", F.col("text").rlike(BULLET).alias("is_bullet"))


def flags(placed: DataFrame) -> DataFrame:
    """doc_id, pages, has_columns, order_confidence."""
    return placed.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"), F.bool_or(F.col("gutter").isNotNull()).alias("has_columns")).withColumn("order_confidence", F.when(F.col("has_columns"), SURE[0]).otherwise(SURE[1]))
