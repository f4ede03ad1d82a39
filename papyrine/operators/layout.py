"""Lines on pages: body size, heading styles, sections, and where a reader looks in the first seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the attention model.
SECONDS, FIXATIONS = 7.4, 4.0
ROLE_WEIGHTS = {"contact": 0.9, "heading": 1.0, "title": 1.0, "meta": 0.65, "statement": 0.55, "item": 0.45, "text": 0.4}
PAGE_DECAY, VERTICAL_DECAY, LEFT_BIAS, LONG_DROP, READ_WORDS, SEEN = 0.55, 1.6, 0.35, 0.6, 8, 0.6


def is_heading(text: Column) -> Column:
    """One to seven words, up to 60 characters, no @, no three digits in a row, no bullet, no final full stop."""
    n = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return n.between(1, 7) & (F.length(text) <= 60) & ~text.rlike(r"@|[0-9]{3}|^[ ]*[-*•]|\.$")


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, body: the half-point size with the most characters; of equals the one seen first."""
    sized = lines.select("doc_id", F.round(F.col("size") * 2).alias("h"), F.length("text").alias("n"), "line")
    sums = sized.groupBy("doc_id", "h").agg(F.sum("n").alias("n"), F.min("line").alias("line"))
    return sums.groupBy("doc_id").agg((F.max_by("h", F.struct("n", -F.col("line"))) / 2).alias("body"))


def sections(lines: DataFrame) -> DataFrame:
    """lines with section: the line number of the last heading so far, -1 before the first."""
    running = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.coalesce(F.last(F.when(is_heading(F.col("text")), F.col("line")), ignorenulls=True).over(running), F.lit(-1).cast("long")))


def heading_styles(lines: DataFrame) -> DataFrame:
    """Styles (size, bold, capitals) that two headings or more of a document have."""
    styled = lines.filter(is_heading(F.col("text"))).select("doc_id", "size", (F.col("bold") >= 0.6).alias("is_bold"), (F.upper("text") == F.col("text")).alias("caps"))
    return styled.groupBy("doc_id", "size", "is_bold", "caps").agg(F.count("*").alias("n")).filter("n >= 2")


def middle_size(lines: DataFrame) -> DataFrame:
    """doc_id, _mid: the upper median of the lines' sizes in half points, from counts by size."""
    counts = lines.groupBy("doc_id", (F.round(F.col("size") * 2) / 2).alias("_h")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("doc_id").orderBy("_h"))
    whole = F.sum("_c").over(Window.partitionBy("doc_id"))
    return counts.withColumns({"_upto": upto, "_whole": whole}).filter(2 * F.col("_upto") > F.col("_whole")).groupBy("doc_id").agg(F.min("_h").alias("_mid"))


def attention(lines: DataFrame) -> DataFrame:
    """lines with weight (share of the document's peak), fixations, hot and seen.

    lines: doc_id, line, page, x0, y0, width, height, size, bold, role, statement (or null), place (in its statement), text.
    """
    doc = Window.partitionBy("doc_id")
    with_body = lines.join(middle_size(lines), "doc_id")
    role = F.coalesce(*(F.when(F.col("role") == k, F.lit(v)) for k, v in ROLE_WEIGHTS.items()), F.lit(0.4))
    zero, one = F.lit(0.0), F.lit(1.0)
    w = role * F.exp(-VERTICAL_DECAY * F.col("y0") / F.greatest(one, F.col("height"))) * F.pow(F.lit(PAGE_DECAY), F.col("page"))
    w = w * (1 - LEFT_BIAS * F.least(one, F.greatest(zero, F.col("x0") / F.greatest(one, F.col("width")) - 0.08) / 0.5))
    w = w * (1 + 0.6 * F.greatest(zero, F.col("size") / F.col("_mid") - 1)) * (1 + 0.3 * F.col("bold"))
    w = w * F.when(F.col("text").rlike(r"[0-9]+(\.[0-9]+)?[ ]?%|\$[ ]?[0-9]|(^|[^A-Za-z0-9_])[0-9]{2,}([^A-Za-z0-9_]|$)"), 1.15).otherwise(1.0)
    w = w * F.when(F.col("place") >= 2, LONG_DROP).otherwise(1.0)
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    rows = with_body.withColumns({"_w": w, "_n": n})
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("doc_id", "statement").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hot = F.when(F.col("statement").isNull(), 1.0).otherwise(F.greatest(zero, F.least(one, (READ_WORDS - before) / F.greatest(F.col("_n"), F.lit(1)))))
    rows = rows.withColumns({"_fix": SECONDS * FIXATIONS * F.col("_w") / F.sum("_w").over(doc), "weight": F.round(F.col("_w") / F.max("_w").over(doc), 3), "_hot": hot})
    return rows.select(*lines.columns, "weight", F.round("_fix", 2).alias("fixations"), F.round("_hot", 2).alias("hot"), ((F.col("_fix") >= SEEN) & (F.col("_hot") > 0)).alias("seen"))
