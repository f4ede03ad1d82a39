"""Readers' texts come from one gathering of a document's pieces; dates are found where they were."""

from __future__ import annotations

import random
import re

import pyarrow as pa

from papyrine.operators import views

WRITTEN = r"(?i)(?:\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+[0-9]{4}\b|\b[0-9]{1,2}/[0-9]{4}\b)"


def test_pieces_are_shuffled_once(spark, capsys):
    rows = [(1, 0, 0, 36.0, 60.0, "a"), (1, 0, 1, 300.0, 61.0, "b"), (1, 0, 2, None, None, "c"), (1, 1, 0, 36.0, 61.0, None), (1, 1, 1, 30.0, 61.0, "d")]
    texts = views.view_texts(spark.createDataFrame(rows, "doc_id long, page long, piece long, x0 double, y1 double, text string"))
    texts.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
    assert {r.view: r.text for r in texts.collect()} == {"stream": "a\nb\nc\n\nd", "rows": "c\na b\nd "}


def test_dates_begin_where_they_did(spark):
    rng = random.Random(7)
    parts = ["Jan", "mar", "DECEMBER", ".", " ", "  ", "2019", "20", "/", "05", "xMay", "may", "_", "é", "-", "3/2020", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(12)) for _ in range(3000)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(f"regexp_extract_all(t, r\"{WRITTEN}\", 0) AS a", f"regexp_extract_all(t, r\"{views.DATE}\", 0) AS b").collect()
    assert all(r.a == r.b for r in found) and sum(map(bool, (r.a for r in found))) > 100


def test_places_of_a_reference_are_kept_between_readers():
    rows = [("one two three", "one two three"), ("one two three", "three two one"), ("one two three", "Three, two; one"), ("four", "one"), (None, "one"), ("four", "four four"), ("four", None)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "view": "stream", "text": seen, "reference": own} for i, (own, seen) in enumerate(rows)])
    got = next(views._kept([batch])).column("integrity").to_pylist()
    want = []
    for own, seen in rows:
        a, b = (re.findall(r"\w+", (t or "").lower()) for t in (own, seen))
        want.append(round(2 * views.common(a, b) / (len(a) + len(b)), 3) if a and b else 0.0)
    assert got == want == [1.0, 0.333, 0.333, 0.0, 0.0, 0.667, 0.0]
