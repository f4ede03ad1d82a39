from __future__ import annotations

from papyrine.operators import reports, rewrites


def test_number_gate_blocks_new_figures(spark):
    rows = spark.createDataFrame([(1, "Cut cost from 850 to 120, over four quarters of work")], "id long, text string")
    got = {r.kind: (r.accepted, r.faithful) for r in rewrites.number_gate(rewrites.perturbed(rows)).collect()}
    assert got["trim"] == (True, True) and got["reorder"] == (True, True) and got["add_percent"] == (False, False)
    assert got["add_count"] == (False, False) and got["inflate_number"] == (False, False)
    long = spark.createDataFrame([(1, "Moved 123456789012345678901 rows")], "id long, text string")
    assert {r.rewrite for r in rewrites.perturbed(long).collect() if r.kind == "inflate_number"} == {f"Moved {123456789012345678901 * 3 + 7} rows"}
    plain = spark.createDataFrame([(1, "No figures")], "id long, text string")
    assert "inflate_number" not in {r.kind for r in rewrites.perturbed(plain).collect()}


def test_gates_caps_and_agreement(spark):
    assert rewrites.ship_decision({"fabrication": 0.01, "well_formed": 0.98, "judge": 0.7, "star": 0.9}) == {"fabrication": True, "well_formed": False, "judge": True, "star": True}
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b", i % 3) for i in range(20)], "id long, task string, verdict int")
    assert rewrites.capped_mix(rows, "task", {"a": 3}, "id").count() == 3
    other = rows.selectExpr("id", "task", "if(id < 5, verdict, 9) AS verdict")
    assert rewrites.agreeing(rows, other, "id", "verdict").count() == 5


def test_placement_takes_the_first_line(spark):
    units = spark.createDataFrame([(1, 0, 7, 50.0, 33.0), (1, 0, 8, 500.0, 33.0)], "doc_id long, page int, unit long, cx double, cy double")
    lines = spark.createDataFrame([(1, 0, 1, 36.0, 20.0, 90.0, 32.0), (1, 0, 2, 36.0, 30.0, 90.0, 42.0)], "doc_id long, page int, line long, x0 double, y0 double, x1 double, y1 double")
    assert [(r.unit, r.line) for r in rewrites.placed_units(units, lines).collect()] == [(7, 1)]


def test_hidden_spans_and_order(spark):
    spans = [(3, 1.0, 10.0, 0, 0, 0, 255, 255, 255), (0, 0.0, 10.0, 0, 0, 0, 255, 255, 255), (0, 1.0, 2.0, 0, 0, 0, 255, 255, 255), (0, 1.0, 10.0, 250, 250, 250, 255, 255, 255), (0, 1.0, 10.0, 120, 120, 120, 255, 255, 255), (0, 1.0, 10.0, 255, 255, 255, 0, 0, 0)]
    rows = spark.createDataFrame(spans, "render_mode int, opacity double, size double, r int, g int, b int, bg_r int, bg_g int, bg_b int")
    assert [r.reason for r in reports.hidden_spans(rows).collect()] == ["invisible", "transparent", "tiny", "low_contrast", None, None]
    a = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "three four one two")], "doc_id long, text string")
    assert reports.reading_order_integrity(a, b).first().integrity == 0.667


def test_timeline_findings(spark):
    entries = [("r", 1, 0, 10, True), ("r", 2, 5, 12, True), ("r", 3, 30, 32, False), ("r", 4, 9, 3, True), ("r", 5, None, None, True), ("r", 6, 90, 99, True)]
    rows = spark.createDataFrame(entries, "owner string, id long, start long, end long, full_time boolean")
    got = {r.finding: (r.severity, r.n) for r in reports.timeline_findings(rows, 95).collect()}
    assert got == {"overlap": ("warning", 1), "gap": ("info", 2), "end_before_start": ("error", 1), "undated": ("info", 1), "future": ("warning", 1)}
