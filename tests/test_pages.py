"""Gutters, reading order and rows of pages against plain versions."""

from __future__ import annotations

import random

from papyrine.operators import pages

SCHEMA = "doc_id long, page long, piece long, x0 double, y0 double, x1 double, y1 double, text string, size double, bold boolean, width double"


def gutter_by_hand(items: list[tuple], width: float):
    best = None
    for g in range(int(width * 0.3), int(width * 0.7), 2):
        left, right = sum(i[5] <= g for i in items), sum(i[3] >= g for i in items)
        cross = sum(i[3] < g < i[5] for i in items)
        if len(items) >= 16 and left >= 8 and right >= 8 and cross <= max(2, len(items) * 0.06) and (best is None or 10 * cross - min(left, right) < best[0]):
            best = (10 * cross - min(left, right), float(g), cross)
    return best and best[1:]


def rows_by_hand(items: list[tuple]) -> list[list[int]]:
    out = []
    for i in sorted(items, key=lambda i: (round((i[4] + i[6]) / 2), i[3], i[2])):
        if out and abs((out[-1][0][4] + out[-1][0][6]) / 2 - (i[4] + i[6]) / 2) <= 2.5:
            out[-1].append(i)
        else:
            out.append([i])
    return [[i[2] for i in sorted(g, key=lambda i: (i[3], i[2]))] for g in out]


def made(seed: int, n_pages: int) -> list[tuple]:
    rng, out = random.Random(seed), []
    for page in range(n_pages):
        columns = rng.choice([1, 2, 2])
        for piece in range(rng.choice([5, 20, 40])):
            x = 36 + 280 * (piece % columns) + rng.choice([0, 0, 60])
            wide = rng.random() < 0.03
            y = 40.0 + rng.choice([12, 3]) * (piece // columns) + rng.choice([0, 0.5, 1])
            out.append((page // 3, page % 3, piece, float(x), y, x + float(400 if wide else rng.choice([80, 160, 200])), y + 10, rng.choice(["word", "two words", "a , b", "", "• x"]), rng.choice([10.0, 10.0, 14.0]), rng.random() < 0.2, 612.0))
    return out


def test_gutters_and_rows(spark):
    items = made(1, 60)
    by_page: dict[tuple, list] = {}
    for i in items:
        by_page.setdefault(i[:2], []).append(i)
    frame = spark.createDataFrame(items, SCHEMA)
    want = {k: g for k, v in by_page.items() if (g := gutter_by_hand(v, 612.0))}
    got = {(r.doc_id, r.page): (r.gutter, r.crossing) for r in pages.gutters(frame).collect()}
    assert got == want and 5 < len(want) < 60
    placed = pages.in_rows(pages.regions(frame)).collect()
    groups: dict[tuple, dict] = {}
    for r in placed:
        groups.setdefault((r.doc_id, r.page, r.region), {}).setdefault(r.row, []).append((r.x0, r.piece))
    for (doc, page, region), rows in groups.items():
        own = [i for i in by_page[doc, page] if any(i[2] == p for row in rows.values() for _, p in row)]
        assert [[p for _, p in sorted(rows[k])] for k in sorted(rows)] == rows_by_hand(own)
    assert sum(len(v) for g in groups.values() for v in g.values()) == len(items)


def test_two_columns_are_read_one_after_the_other(spark):
    head = [(1, 0, 0, 36.0, 20.0, 560.0, 34.0, "Headline", 18.0, True, 612.0)]
    body = [(1, 0, 1 + i, 36.0 + 280 * (i % 2), 60.0 + 12 * (i // 2), 230.0 + 280 * (i % 2), 70.0 + 12 * (i // 2), f"{'left' if i % 2 == 0 else 'right'} {i // 2}", 10.0, False, 612.0) for i in range(20)]
    placed = pages.regions(spark.createDataFrame(head + body, SCHEMA))
    rows = pages.rows(pages.in_rows(placed)).orderBy("line").collect()
    assert [r.text for r in rows] == ["Headline", *(f"left {i}" for i in range(10)), *(f"right {i}" for i in range(10))]
    assert [tuple(r) for r in pages.flags(placed).collect()] == [(1, 1, True, 0.75)]
    few = spark.createDataFrame(body[:4] + [(1, 0, 99, 300.0, 62.0, 310.0, 72.0, " ,  end", 12.0, True, 612.0)], SCHEMA)
    merged = pages.rows(pages.in_rows(pages.regions(few))).orderBy("line").collect()
    assert [r.text for r in merged] == ["left 0, end right 0", "left 1 right 1"] and merged[0].size == 10.0 and not merged[0].first_bold and merged[0].bold == 0.32
    empty = spark.createDataFrame([], SCHEMA)
    assert pages.rows(pages.in_rows(pages.regions(empty))).count() == 0
