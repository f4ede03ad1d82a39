"""Entries of a section: where they begin among its rows, and their titles, dates, tags, further rows and statements.

Rows are those of a page in reading order. Three layouts are told apart: titles that begin in bold, titles in larger type,
and plain rows that stand to the left of bullets. A row's place depends on rows before it only by the last row that decides
for itself, so windows over a section's rows do for what else would be a walk along them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import text_of
from papyrine.operators.statements import sentence_parts

# How dates are written, signs of bullets, what stands between a title and its tags, and kinds of sections.
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE_TOKEN = rf"(?:{MONTH}\.?\s+[0-9]{{4}}|[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{4}})"
RANGE = rf"(?i)({DATE_TOKEN})\s*(?:[-–—]|to)\s*({DATE_TOKEN}|Present|Current|Now|Ongoing)"
SINGLE = rf"(?i)\(?({MONTH}\.?\s+[0-9]{{4}}|\b(?:19|20)[0-9]{{2}}\b)\)?"
#: The same where a date can begin: one look at the letter spares trying all months at each place.
_RANGE_AT = RANGE.replace("(?i)", "(?i)(?=[JFMASOND0-9])", 1)
#: What every range has: a year with its sign, which is looked for at figures only.
_YEAR_TO = r"(?i)[0-9]{4}\s*(?:[-–—]|to)"
_SINGLE_AT = SINGLE.replace("(?i)", "(?i)(?=[(JFMASOND12])", 1)
BULLET = r"^\s*([•●▪■◦‣⁃►▶➢➤→*·○◆◇❖✓✔➔»▫◾-]\s*|-\s+[A-Za-z(\"“])"
BULLET_SIGN = r"^\s*[•●▪■◦‣⁃►▶➢➤→*·○◆◇❖✓✔➔»▫◾-]\s*"
DASH = r"\s+[—–|]\s+|\s+-\s+"
EDGES = " ,–—-|"
ENTRY_KINDS = ["experience", "education", "projects", "certifications", "training", "publications", "volunteer", "leadership", "achievements", "extracurricular"]
ITEM_KINDS = ["skills", "languages", "interests"]
LIST_KINDS = [*ITEM_KINDS, "extracurricular", "achievements", "training"]
#: Points: by how much large type is larger and how alike it is; by how far a row stands left of bullets, or a bold one right of titles.
LARGER, ALIKE, OUTDENT, INDENT = 0.8, 0.3, 4, 6
#: Dates that are taken out of titles, one after the other.
_REMOVED = [RANGE, rf"(?i)\(\s*(?:{MONTH}\.?\s+)?[0-9]{{4}}\s*\)", rf"(?i)[,\s]+{MONTH}\.?\s+[0-9]{{4}}\s*$", r"\s+(?:19|20)[0-9]{2}\s*$"]


def bare(text: Column) -> Column:
    """A row's text without its bullet."""
    return F.btrim(F.regexp_replace(text, BULLET_SIGN, ""))


def find_dates(text: Column) -> Column:
    """'a – b' of the first range, else the first date alone, else an empty string."""
    a, b = (F.when(text.rlike(_YEAR_TO), F.regexp_extract(text, _RANGE_AT, k)).otherwise("") for k in (1, 2))
    return F.when(a != "", F.concat(a, F.lit(" – "), b)).otherwise(F.regexp_extract(text, _SINGLE_AT, 1))


def _n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def remove_dates(text: Column) -> Column:
    out = F.when(text.rlike(_YEAR_TO), F.regexp_replace(text, _RANGE_AT, "")).otherwise(text)
    for pattern in _REMOVED[1:]:
        out = F.regexp_replace(out, pattern, "")
    return F.btrim(F.regexp_replace(out, r"\s{2,}", " "), F.lit(EDGES))


def split_title(title: Column) -> tuple[Column, Column]:
    """What stands before and after the first dash of a title without its dates."""
    parts = F.split(remove_dates(title), DASH, 2)
    return F.btrim(F.get(parts, F.lit(0)), F.lit(EDGES)), F.btrim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.lit(EDGES))


def segmented(rows: DataFrame) -> DataFrame:
    """rows with entry (number in the section, from 0), part (title or rest) and plain (the layout without bold or large titles).

    rows: doc_id, section, kind, line (their order), text, x0, size, bold (share of characters), first_bold. Null texts are
    empty rows. The first row of a section always begins an entry; repeated line numbers have no certain order.
    """
    section = Window.partitionBy("doc_id", "section")
    order = section.orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    text = bare(text_of(F.col("text")))
    # The order comes first: what else is asked of a section needs no other sort.
    marked = rows.withColumns({"_bullet": text_of(F.col("text")).rlike(BULLET), "_range": text.rlike(_YEAR_TO) & text.rlike(_RANGE_AT)}).withColumn("_at", F.row_number().over(order))
    marked = marked.withColumn("_dated", ~F.col("_bullet") & (F.col("_range") | text.rlike(_SINGLE_AT)) & (_n_words(text) <= 12))
    count = lambda c: F.sum(c.cast("int")).over(section)
    # The upper median of the bullets' left edges: the percentile keeps counts by edge.
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN _bullet THEN x0 END DESC)")
    marked = marked.withColumns({
        "_bulleted": count(F.col("_bullet") & F.col("first_bold")) >= 2, "_title_x": F.coalesce(F.min(F.when(F.col("first_bold"), F.col("x0"))).over(section), F.lit(0.0)), "_bullet_x": middle.over(section),
        "_any_bold": F.bool_or("first_bold").over(section), "_max": F.max("size").over(section), "_min": F.min("size").over(section), "_bullets": count(F.col("_bullet")),
    })
    large = F.col("size") >= F.col("_max") - ALIKE
    marked = marked.withColumn("_large", ~F.col("_any_bold") & (F.col("_max") - F.col("_min") >= LARGER) & (F.col("_min") < F.col("_max") - ALIKE))
    marked = marked.withColumn("plain", F.col("kind").isin(ENTRY_KINDS) & ~F.col("_any_bold") & ~F.col("_large") & (F.col("_bullets") >= 2))

    # Plain rows: the first candidate after a bullet begins an entry.
    candidate = ~F.col("_bullet") & ((F.col("x0") < F.col("_bullet_x") - OUTDENT) | F.col("_dated"))
    marked = marked.withColumn("_candidate", candidate)
    seen = {f"_last{c}": F.max(F.when(F.col(c), F.col("_at"))).over(before) for c in ("_bullet", "_candidate")}
    last_bullet, last_candidate = (F.col(c) for c in seen)
    plain_new = F.col("_candidate") & last_bullet.isNotNull() & (last_candidate.isNull() | (last_candidate < last_bullet))
    plain_title = F.when(F.col("_at") == 1, ~F.col("_bullet") & (F.col("x0") < F.col("_bullet_x") - OUTDENT)).otherwise(plain_new)

    # Bold or large titles: T, a title; L, an item that is its own title; R, a row of the rest. Rows in bold between bulleted
    # bold titles that are no bullet and have no date decide by what stands before them; all others decide for themselves.
    raw = F.when(F.col("_large"), large).otherwise(F.col("first_bold") & (F.col("bold") >= 0.25)) & (F.col("kind") != "summary")
    far = F.col("x0") > F.col("_title_x") + INDENT
    items, listed = F.col("kind").isin(ITEM_KINDS), F.col("kind").isin(LIST_KINDS) & F.col("_bullet")
    first = F.col("_at") == 1
    marked = marked.withColumns({"_raw": raw, "_soft": F.col("_bulleted") & raw & ~F.col("_bullet") & ~F.col("_range")})
    titled = F.when(F.col("_soft") & first, ~far).otherwise(F.col("_raw"))
    firm = F.when(F.col("_soft") & ~first, F.lit(None)).otherwise(F.when(titled, "T").when((listed | first) & items, "L").otherwise("R"))
    # What both layouts ask of the rows before is asked at once.
    marked = marked.withColumn("_firm", firm).withColumns({**seen, "_above": F.lag("_firm").over(order)}).withColumns({"_new1": plain_new, "_title1": plain_title})
    above = F.col("_above")
    decided = F.when(F.col("_firm").isNotNull(), F.col("_firm")).when(above == "L", F.when(far, "R").otherwise("T")).otherwise(above)
    marked = marked.withColumn("_state", decided)
    marked = marked.withColumn("_state", F.last("_state", ignorenulls=True).over(upto))
    was_title = F.coalesce(F.lag("_state").over(order), F.lit("R")) == "T"
    new = first | F.when(F.col("_state") == "T", F.col("_bullet") | ~was_title | F.col("_range")).otherwise(listed)
    new = F.when(F.col("plain"), first | F.coalesce(F.col("_new1"), F.lit(False))).otherwise(new)
    part = F.when(F.when(F.col("plain"), F.coalesce(F.col("_title1"), F.lit(False))).otherwise(F.col("_state").isin("T", "L")), "title").otherwise("rest")
    out = marked.withColumn("_new", new.cast("long")).withColumn("entry", F.sum("_new").over(upto) - 1)
    return out.select(*rows.columns, "entry", part.alias("part"), "plain", F.col("_bullet").alias("bullet"))


def roles(rows: DataFrame) -> DataFrame:
    """Segmented rows with role: title, meta, statement or item, and group, the statement that a row of the rest belongs to.

    Up to two short rows without a bullet or final full stop right after a title are meta. If any other row of the rest has
    a bullet, each bullet and the first row begin a group; otherwise all are one group, which is cut into sentences.
    """
    entry = Window.partitionBy("doc_id", "section", "entry")
    order = entry.orderBy("line")
    text = bare(text_of(F.col("text")))
    rest = F.col("part") == "rest"
    fits = ~F.col("bullet") & (_n_words(text) <= 10) & ~text.endswith(".")
    marked = rows.withColumn("_unfit", (rest & ~fits).cast("int")).withColumns({"_place": F.sum(rest.cast("int")).over(order), "_unfit": F.coalesce(F.sum("_unfit").over(order), F.lit(0))})
    marked = marked.withColumn("_titled", F.bool_or(~rest).over(entry)).withColumn("_meta", rest & F.col("_titled") & (F.col("_unfit") == 0) & (F.col("_place") <= 2))
    told = rest & ~F.col("_meta")
    marked = marked.withColumns({"_told": told, "_signs": F.bool_or(told & F.col("bullet")).over(entry)})
    begins = F.col("_told") & (F.col("bullet") | (F.sum(F.col("_told").cast("int")).over(order) == 1)) & F.col("_signs")
    item = F.col("kind").isin(ITEM_KINDS)
    role = F.when(F.col("_meta"), "meta").when(item, "item").when(rest, "statement").otherwise("title")
    marked = marked.withColumns({"_begins": begins.cast("long"), "role": role})
    group = F.when(F.col("_told"), F.when(F.col("_signs"), F.sum("_begins").over(order)).otherwise(0))
    return marked.withColumn("group", group).select(*rows.columns, "role", "group")


def built(rows: DataFrame) -> DataFrame:
    """doc_id, section, entry, title, tags, dates, subtitle, n_statements from rows with roles.

    An entry's rows are gathered in order: they are one entry of one section.
    """
    rest = F.col("part") == "rest"
    row = F.struct("line", text_of(F.col("text")).alias("raw"), rest.alias("rest"), (F.col("role") == "meta").alias("meta"), F.col("group").alias("g"))
    held = rows.groupBy("doc_id", "section", "entry").agg(F.sort_array(F.collect_list(row)).alias("p"), F.bool_or("plain").alias("plain"))

    def joined(condition: Callable[[Column], Column], sign: str) -> Column:
        return F.array_join(F.transform(F.filter("p", condition), lambda x: bare(x["raw"])), sign)

    early = F.transform(F.slice(F.filter("p", lambda x: x["rest"]), 1, 2), lambda x: x["raw"])
    groups = F.array_distinct(F.transform(F.filter("p", lambda x: x["g"] > 0), lambda x: x["g"]))
    whole = held.select(
        "doc_id", "section", "entry", joined(lambda x: ~x["rest"], " ").alias("whole"), F.array_join(early, " ").alias("early"), joined(lambda x: x["meta"], " · ").alias("meta"), "plain", F.size(groups).alias("n_groups"),
        joined(lambda x: x["g"] == 0, " ").alias("told"),
    )
    # Each is a column of its own, so none is worked out once more where it is asked for twice.
    name, tail = split_title(F.col("whole"))
    shown = F.btrim(remove_dates(F.col("meta")), F.lit(" ·,-–"))
    out = whole.withColumns({"name": name, "tail": tail, "shown": shown, "dates": find_dates(F.col("whole"))})
    out = out.withColumn("dates", F.when(F.col("dates") != "", F.col("dates")).otherwise(find_dates(F.col("early"))))
    out = out.withColumn("subtitle", F.when(F.col("plain") & (F.col("shown") != ""), F.col("shown")).otherwise(F.col("meta")))
    dates = F.when(F.col("dates") != "", F.col("dates")).otherwise(find_dates(F.col("subtitle")))
    tags = F.when(F.col("tail") == "", F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split("tail", r",\s*"), lambda t: F.btrim(t)), lambda t: t != ""))
    out = out.withColumns({"title": F.when(F.col("name") != "", F.col("name")).otherwise(F.col("whole")), "tags": tags})
    said = F.size(F.filter(sentence_parts(F.col("told")), lambda x: F.regexp_replace(x, r"\s+$", "") != ""))
    done = out.withColumns({"dates": dates, "n_sentences": F.when(F.col("told") != "", said).otherwise(0)})
    return done.select("doc_id", "section", "entry", "title", F.array_join("tags", "; ").alias("tags"), "dates", "subtitle", (F.col("n_groups") + F.col("n_sentences")).cast("long").alias("n_statements"))
