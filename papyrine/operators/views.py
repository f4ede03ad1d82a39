"""What simple readers make of pages: their texts, how much of the order they keep, and which fields and dates they lose.

Three readers: `stream` takes pieces as they come, `rows` takes whole rows across the page, `tables` runs the cells of tables
together. The order that pages.rows() gives is what they are compared with.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import text_of

# How dates are written, the height of a reader's rows, what counts as kept, and the order of readers.
# Where no date can begin one look at the letter is enough.
DATE = r"(?i)(?=[JFMASOND0-9])\b(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+[0-9]{4}\b|[0-9]{1,2}/[0-9]{4}\b)"
BAND, KEPT, FAIR = 3.0, 0.95, 0.85
READERS = ["stream", "rows", "tables"]


def _joined(order: list[Column], sign: str) -> Column:
    held = F.sort_array(F.collect_list(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), text_of(F.col("text")).alias("t"))))
    return F.array_join(F.transform(held, lambda x: x["t"]), sign)


def view_texts(pieces: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """doc_id, view, text: what each reader makes of a document's pieces (of pages.py) and table cells.

    cells: doc_id, page, cell (their order), text. A document is gathered: its pieces are what its pages hold.
    """
    piece = F.struct("page", F.bround(F.col("y1") / BAND, 0).alias("row"), F.col("x0").alias("x"), "piece", text_of(F.col("text")).alias("t"))
    held = pieces.groupBy("doc_id").agg(F.collect_list(piece).alias("p"))
    came = F.sort_array(F.transform("p", lambda x: F.struct(x["page"], x["piece"], x["t"].alias("t"))))
    read = held.select("doc_id", came.alias("came"), F.sort_array("p").alias("across"))

    def after(x: Column, i: Column) -> Column:
        above = F.get("across", i - 1)
        same = above["page"].eqNullSafe(x["page"]) & above["row"].eqNullSafe(x["row"])
        return F.when(i == 0, x["t"]).otherwise(F.concat(F.when(same, F.lit(" ")).otherwise(F.lit("\n")), x["t"]))

    texts = {"stream": F.array_join(F.transform("came", lambda x: x["t"]), "\n"), "rows": F.array_join(F.transform("across", after), "")}
    out = read.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("view"), t.alias("text")) for k, t in texts.items()))).alias("v")).select("doc_id", "v.*")
    if cells is not None:
        run = cells.groupBy("doc_id").agg(_joined([F.col("page"), F.col("cell")], "").alias("text"))
        out = out.unionByName(run.select("doc_id", F.lit("tables").alias("view"), "text"))
    return out


def common(a: list, b: list) -> int:
    """The length of the longest common subsequence: a bit for each place of b, a step for each item of a.

    A zero bit stands where a common subsequence of what has been read grows by one; each item moves these to its own places.
    """
    return _grown(a, _places(b), len(b))


def _places(b: list) -> dict:
    places: dict = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    return places


def _grown(a: list, places: dict, n: int) -> int:
    whole = (1 << n) - 1
    bits = whole
    for x in a:
        if x in places:
            here = bits & places[x]
            bits = (bits + here | bits - here) & whole
    return n - bits.bit_count()


def _kept(batches):
    words = re.compile(r"\w+")
    # Readers of one document follow one another: its places are found once, and texts of the same words are compared once.
    reference, b, places, before, share = None, [], {}, None, 0.0
    for batch in batches:
        shares = []
        for own, seen in zip(batch.column("reference").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if own != reference or before is None:
                reference, b, before = own, words.findall((own or "").lower()), None
                places = _places(b)
            a = words.findall((seen or "").lower())
            if a != before:
                kept = len(b) if a == b else _grown(a, places, len(b))
                before, share = a, round(2 * kept / (len(a) + len(b)), 3) if a and b else 0.0
            shares.append(share)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "view", "text", "reference")), pa.array(shares, pa.float64())], ["doc_id", "view", "text", "reference", "integrity"])


def integrity(views: DataFrame, references: DataFrame) -> DataFrame:
    """views with reference and integrity: twice the words kept in order, by all words of both; 0 if either has none.

    references: doc_id, text. Two halves that change places keep only one of them, whatever stands side by side.
    """
    rows = views.join(references.select("doc_id", F.col("text").alias("reference")), "doc_id").select("doc_id", "view", "text", "reference")
    return rows.mapInArrow(_kept, "doc_id long, view string, text string, reference string, integrity double")


def checked(views: DataFrame, contacts: DataFrame) -> DataFrame:
    """doc_id, view, integrity, n_dates, n_lost, email_kept, phone_kept, n_issues of views with integrity.

    contacts: doc_id, email, phone (null: not expected). Dates of the reference count once each as written. Of the tables'
    reader only fields are asked, and these aren't held against it.
    """
    plain = lambda c: F.regexp_replace(text_of(c), "[^0-9]+", "")
    rows = views.join(contacts.select("doc_id", "email", "phone"), "doc_id", "left")
    dates = F.array_distinct(F.regexp_extract_all("reference", F.lit(DATE), F.lit(0)))
    rows = rows.withColumns({"_dates": dates, "email_kept": F.contains(F.lower("text"), F.lower("email")), "phone_kept": F.when(F.col("phone").isNotNull(), F.contains(plain(F.col("text")), plain(F.col("phone"))))})
    lost = F.size(F.filter("_dates", lambda d: ~F.contains(F.col("text"), d)))
    scored = F.col("view") != "tables"
    issues = F.when(scored, (lost > 0).cast("int") + ((F.col("integrity") > 0) & (F.col("integrity") < FAIR)).cast("int") + F.coalesce((~F.col("email_kept")).cast("int"), F.lit(0)) + F.coalesce((~F.col("phone_kept")).cast("int"), F.lit(0))).otherwise(1)
    return rows.select("doc_id", "view", F.when(scored, F.col("integrity")).otherwise(0.0).alias("integrity"), F.size("_dates").cast("long").alias("n_dates"), lost.cast("long").alias("n_lost"), "email_kept", "phone_kept", issues.cast("long").alias("n_issues"))


def verdicts(checks: DataFrame) -> DataFrame:
    """doc_id, worst_view, integrity, has_tables, low_risk, n_unkept: the reader that keeps least (the first of equals) and what follows.

    low_risk: it keeps KEPT or more and there are no tables. n_unkept: fields that not every reader keeps.
    """
    scored = F.col("view") != "tables"
    place = F.array_position(F.array(*map(F.lit, READERS)), F.col("view"))
    worst = F.min(F.when(scored, F.struct("integrity", place.alias("place"), "view")))
    lost = [F.coalesce(F.max(F.when(scored, (~F.col(c)).cast("long"))), F.lit(0)) for c in ("email_kept", "phone_kept")]
    rows = checks.groupBy("doc_id").agg(worst.alias("w"), F.bool_or(~scored).alias("has_tables"), (lost[0] + lost[1]).alias("n_unkept"))
    return rows.select("doc_id", F.col("w.view").alias("worst_view"), "w.integrity", "has_tables", ((F.col("w.integrity") >= KEPT) & ~F.col("has_tables")).alias("low_risk"), "n_unkept")


def seen_first(lines: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, rank, line, role of the n lines that are looked at longest (of layout.attention()), first lines first among equals."""
    order = Window.partitionBy("doc_id").orderBy(F.col("fixations").desc(), "line")
    return lines.filter("seen").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("doc_id", F.col("rank").cast("long").alias("rank"), "line", "role")
