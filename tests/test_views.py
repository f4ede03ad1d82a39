"""Common subsequences against a table of lengths; readers' texts, lost fields and dates, and verdicts."""

from __future__ import annotations

import random

from papyrine.operators import views


def length_by_table(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
    return row[-1]


def test_common_matches_a_table():
    rng = random.Random(0)
    for size in (0, 1, 5, 30, 80):
        for _ in range(30):
            a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(size + 1))] for _ in range(2))
            assert views.common(a, b) == length_by_table(a, b) == views.common(b, a)
    half = [str(i) for i in range(500)]
    assert views.common(half[:250] + half[250:], half[250:] + half[:250]) == 250


PIECES = "doc_id long, page long, piece long, x0 double, y1 double, text string"


def test_views_fields_and_verdicts(spark):
    left = [(1, 0, i, 36.0, 60.0 + 12 * i, t) for i, t in enumerate(["a@b.org", "one two", "Mar", "three"])]
    right = [(1, 0, 4 + i, 300.0, 60.0 + 12 * i, t) for i, t in enumerate(["+1 (23) 4", "four five", "2020", None])]
    pieces = spark.createDataFrame([*left, *right, (2, 0, 0, 36.0, 60.0, "only this")], PIECES)
    cells = spark.createDataFrame([(1, 0, 1, "x"), (1, 0, 0, "y")], "doc_id long, page long, cell long, text string")
    texts = {(r.doc_id, r.view): r.text for r in views.view_texts(pieces, cells).collect()}
    assert texts == {
        (1, "stream"): "a@b.org\none two\nMar\nthree\n+1 (23) 4\nfour five\n2020\n", (1, "rows"): "a@b.org +1 (23) 4\none two four five\nMar 2020\nthree ", (1, "tables"): "yx",
        (2, "stream"): "only this", (2, "rows"): "only this",
    }
    reference = spark.createDataFrame([(1, "a@b.org one two Mar 2020 three +1 (23) 4 four five 05/2021"), (2, "only this")], "doc_id long, text string")
    kept = views.integrity(views.view_texts(pieces, cells), reference)
    contacts = spark.createDataFrame([(1, "A@b.org", "1-234"), (2, None, None)], "doc_id long, email string, phone string")
    got = {(r.doc_id, r.view): tuple(r)[2:] for r in views.checked(kept, contacts).collect()}
    a = "a b org one two mar 2020 three 1 23 4 four five 05 2021".split()
    for view in ("stream", "rows"):
        b = texts[1, view].lower().replace("@", " ").replace(".", " ").replace("(", " ").replace(")", " ").replace("+", " ").split()
        assert got[1, view][0] == round(2 * length_by_table(a, b) / (len(a) + len(b)), 3)
    assert got[1, "stream"][1:5] == (2, 2, True, True) and got[1, "rows"][1:5] == (2, 1, True, True) and got[1, "tables"][0] == 0.0
    assert got[2, "rows"] == (1.0, 0, 0, None, None, 0)
    verdicts = {r.doc_id: tuple(r)[1:] for r in views.verdicts(views.checked(kept, contacts)).collect()}
    worst = min(("stream", "rows"), key=lambda v: got[1, v][0])
    assert verdicts == {1: (worst, got[1, worst][0], True, False, 0), 2: ("stream", 1.0, False, True, 0)}
