from __future__ import annotations

from papyrine.sources import documents, sinks
from papyrine.streaming import jobs


def test_latex_and_typst(spark):
    tex = r"\section{Experience} \textbf{Built} 50\% more % hidden" + "\n" + r"\begin{itemize}\item Led \emph{teams}\end{itemize} \section*{Education} None"
    rows = spark.createDataFrame([("d", tex)], "doc_id string, text string")
    got = documents.latex_sections(rows).orderBy("section").collect()
    assert [r.heading for r in got] == ["Experience", "Education"]
    assert "Built 50% more" in got[0].text and "hidden" not in got[0].text and "- Led teams" in got[0].text
    typ = spark.createDataFrame([("d", "= Skills\n- Rust\n#text(fill: white)[x]\nplain")], "doc_id string, text string")
    assert [(r.kind, r.section) for r in documents.typst_events(typ).orderBy("line").collect()] == [("heading", "Skills"), ("item", "Skills"), ("hidden", "Skills"), ("text", "Skills")]


def test_uploads_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello")
    (tmp_path / "in/b.exe").write_text("no")
    (tmp_path / "in/c.txt").write_text("")
    assert [r.kind for r in documents.uploads(spark, f"{tmp_path}/in").collect()] == ["txt"]
    assert documents.text_files(spark, f"{tmp_path}/in/a.txt").first().text == "hello"
    rows = spark.createDataFrame([("d", 0, "One", "a & b_c"), ("d", 1, "Two", "x")], "doc_id string, section int, heading string, text string")
    assert sinks.exported_text(rows).first().text == "ONE\na & b_c\n\nTWO\nx"
    assert rows.select(sinks.latex_escaped(rows.text).alias("t")).first().t == r"a \& b\_c"
    sinks.write_results(rows, f"{tmp_path}/out", "1")
    sinks.write_results(rows, f"{tmp_path}/out", "2")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    sinks.write_metrics(rows, f"{tmp_path}/m")
    sinks.write_text(rows, f"{tmp_path}/t")


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Reduced cost by 40% in Kafka.\nNothing")], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/docs")
    jobs.write_stream(jobs.graded_stream(spark, f"{tmp_path}/docs", "doc_id long, text string"), f"{tmp_path}/graded", f"{tmp_path}/c1").awaitTermination()
    assert sorted(r.grade for r in spark.read.parquet(f"{tmp_path}/graded").collect()) == ["A", "D"]
    queue = spark.createDataFrame([(1, "upper", 5, "a"), (2, "upper", 3, "b"), (3, "other", 1, "c")], "job_id long, kind string, created long, payload string")
    queue.write.parquet(f"{tmp_path}/jobs")
    handlers = {"upper": lambda df: df.selectExpr("*", "upper(payload) AS result")}
    jobs.run_jobs(spark, f"{tmp_path}/jobs", "job_id long, kind string, created long, payload string", handlers, f"{tmp_path}/done", f"{tmp_path}/c2").awaitTermination()
    got = {r.job_id: (r.status, r.result, r.place) for r in spark.read.parquet(f"{tmp_path}/done").collect()}
    assert got == {1: ("done", "A", 2), 2: ("done", "B", 1), 3: ("failed", None, 1)}
