"""Entries of sections against a plain walk along the rows, and the fields made of them."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from papyrine.operators import entries

SCHEMA = "doc_id long, section long, kind string, line long, text string, x0 double, size double, bold double, first_bold boolean"


def walked(kind: str, rows: list[dict]) -> list[tuple[int, str]]:
    """(entry, part) of each row, row after row."""
    sign, ranged = re.compile(entries.BULLET), re.compile(entries.RANGE)
    dated = lambda t: bool(ranged.search(t) or re.search(entries.SINGLE, t))
    bare = lambda t: re.sub(entries.BULLET_SIGN, "", t).strip(" ")
    marks = [{"bullet": bool(sign.match(r["text"])), "t": bare(r["text"]), **r} for r in rows]
    bold = any(r["first_bold"] for r in marks)
    sizes = [r["size"] for r in marks]
    large = not bold and max(sizes) - min(sizes) >= 0.8 and sum(s >= max(sizes) - 0.3 for s in sizes) < len(sizes)
    edges = sorted(r["x0"] for r in marks if r["bullet"])
    out, entry, state = [], -1, None  # state: None, or (has title, in title, rows of the rest, has bullets)
    if kind in entries.ENTRY_KINDS and not bold and not large and len(edges) >= 2:
        middle, bullets = edges[len(edges) // 2], False
        for r in marks:
            left = r["x0"] < middle - 4
            begins = not r["bullet"] and (left or (bullets and dated(r["t"]) and len(r["t"].split()) <= 12))
            if begins and (entry < 0 or bullets):
                entry, bullets = entry + 1, False
                out.append((entry, "title"))
            else:
                entry = max(entry, 0)
                bullets = bullets or r["bullet"]
                out.append((entry, "rest"))
        return out
    bulleted = sum(r["bullet"] and r["first_bold"] for r in marks) >= 2
    title_x = min((r["x0"] for r in marks if r["first_bold"]), default=0)
    was_title = has_rest = False
    for i, r in enumerate(marks):
        title = r["size"] >= max(sizes) - 0.3 if large else r["first_bold"] and r["bold"] >= 0.25
        title = title and kind != "summary"
        if bulleted and title and not r["bullet"] and not ranged.search(r["t"]) and ((i and has_rest) or (r["x0"] > title_x + 6 and not was_title)):
            title = False
        new = i == 0 or (title and (r["bullet"] or not was_title or bool(ranged.search(r["t"])))) or (kind in entries.LIST_KINDS and r["bullet"])
        if new:
            entry += 1
            part = "title" if title or kind in entries.ITEM_KINDS else "rest"
            has_rest = part == "rest"
        elif title and was_title and not has_rest:
            part = "title"
        else:
            part, has_rest = "rest", True
        was_title = title and part == "title"
        out.append((entry, part))
    return out


def test_entries_match_a_walk(spark):
    rng = random.Random(4)
    kinds = ["experience", "projects", "skills", "languages", "summary", "achievements", "training", "education", "other"]
    rows, want = [], {}
    for section in range(400):
        style, kind, body = rng.randrange(5), rng.choice(kinds), []
        for line in range(rng.randrange(1, 14)):
            first = rng.random() < 0.5 and style in (0, 1, 2)
            text = rng.choice(["", "• ", "- ", "* "]) + rng.choice(["Works at a place", "Role (May 2020 – June 2021)", "2019 to present", "Study, 2018", "100% recall of parts", "It is said that many words stand in this row of the page so that it is long", ""])
            body.append({"line": 3 * line, "text": text, "x0": float(rng.choice([36, 41, 44, 48])), "size": float(rng.choice([10, 10, 12])) if style in (2, 3) else 10.0, "bold": rng.choice([0.1, 0.3, 1.0]) if first else 0.0, "first_bold": first})
        rows += [(section // 2, section % 2, kind, *r.values()) for r in body]
        want |= {(section // 2, section % 2, r["line"]): w for r, w in zip(body, walked(kind, body), strict=True)}
    found = entries.segmented(spark.createDataFrame(rows, SCHEMA).withColumn("other", F.lit(1))).collect()
    assert {(r.doc_id, r.section, r.line): (r.entry, r.part) for r in found} == want
    assert {r.plain for r in found} == {True, False}


@pytest.mark.parametrize(
    "title, name, tail, dates",
    [
        ("Tool (2026) — Spark, SQL", "Tool", "Spark, SQL", "2026"),
        ("Engineer, Acme (Jan 2020 – Present)", "Engineer, Acme ()", "", "Jan 2020 – Present"),
        ("Clerk | Office 03/2019 to 04/2020", "Clerk", "Office", "03/2019 – 04/2020"),
        ("Study, May 2018", "Study", "", "May 2018"),
        ("Plain title - with a - dash", "Plain title", "with a - dash", ""),
        ("", "", "", ""),
    ],
)
def test_titles_and_dates(spark, title, name, tail, dates):
    got = spark.createDataFrame([(title,)], "t string").select(*(c.alias(n) for c, n in zip((*entries.split_title(F.col("t")), entries.find_dates(F.col("t"))), "abc", strict=True))).first()
    assert tuple(got) == (name, tail, dates)


def test_fields_of_entries(spark):
    text = ["Engine — Java, Go 2020 – 2021", "Acme Inc", "Rome", "• Built a parser", "that is fast", "• Cut costs", "Study of words", "Reads. Writes a lot. Speaks"]
    rows = [(1, 0, "experience", i, t, 36.0, 10.0, float(i in (0, 6)), i in (0, 6)) for i, t in enumerate(text)]
    roles = entries.roles(entries.segmented(spark.createDataFrame(rows, SCHEMA)))
    assert [(r.role, r.group) for r in roles.orderBy("line").collect()] == [("title", None), ("meta", None), ("meta", None), ("statement", 1), ("statement", 1), ("statement", 2), ("title", None), ("meta", None)]
    got = [tuple(r) for r in entries.built(roles).orderBy("entry").collect()]
    assert got == [(1, 0, 0, "Engine", "Java; Go", "2020 – 2021", "Acme Inc · Rome", 2), (1, 0, 1, "Study of words", "", "", "Reads. Writes a lot. Speaks", 0)]
    told = [(2, 0, "summary", i, t, 36.0, 10.0, 0.0, False) for i, t in enumerate(["It reads. It", "writes. Also e.g. This", None])]
    assert [tuple(r)[3:] for r in entries.built(entries.roles(entries.segmented(spark.createDataFrame(told, SCHEMA)))).collect()] == [("", "", "", "", 3)]
    assert entries.built(entries.roles(entries.segmented(spark.createDataFrame([], SCHEMA)))).count() == 0
