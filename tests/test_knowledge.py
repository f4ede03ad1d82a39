"""Roles, norms, knowledge files, SQL functions and the life cycle of jobs."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from papyrine.functions import sql
from papyrine.operators import entries, intervals, norms, reports, roles, semantic, statements, wording
from papyrine.sources import knowledge
from papyrine.streaming import lifecycle


def test_roles(spark):
    families = spark.createDataFrame([("data", "Power BI", 0), ("data", "sql", 0), ("web", "node.js", 1), ("web", "css", 1)], "family string, keyword string, place long")
    fields = [(1, "summary", "SQL and css"), (1, "skills", "css, CSS"), (1, "raw", "css css"), (2, "statements", "power bi; Node.JS sqlx"), (3, "raw", "used css"), (3, "summary", None), (4, "raw", "nothing")]
    got = {r.doc_id: (r.family, r.score, r.from_raw) for r in roles.inferred_roles(spark.createDataFrame([(k,) for k in range(1, 6)], "doc_id long"), spark.createDataFrame(fields, "doc_id long, field string, text string"), families).collect()}
    assert got == {1: ("web", 5, False), 2: ("data", 2, False), 3: ("web", 1, True), 4: (None, 0, True), 5: (None, 0, True)}
    held = spark.createDataFrame([("a", "title", "data engine"), ("a", "body", "moves data all day"), ("b", "title", "web page"), ("b", "body", "shows data")], "role string, field string, text string")
    ranked = roles.ranked_roles(spark.createDataFrame([(1, "the data engine"), (2, "page"), (3, "none")], "doc_id long, text string"), held, {"title": 3.0, "body": 1.0}).collect()
    assert [(r.doc_id, r.role, r["rank"]) for r in sorted(ranked)] == [(1, "a", 1), (1, "b", 2), (2, "b", 1)] and all(0.5 <= r.confidence <= 1 for r in ranked)


def test_norms(spark):
    level = {"expected_sections": ["projects", "skills"], "typical_tools": ["Spark", "SQL", "Git", "Rust"], "expected_metrics": ["Latency of calls", "cost"], "anti_patterns": ["No baseline given", "other"]}
    data = {"role_family": "data", "roles": [{"id": "r1", "canonical_title": "Engineer", "seniority_levels": {"entry": level, "senior": {"expected_sections": ["summary"]}}}, {"id": "r2", "canonical_title": "Analyst", "seniority_levels": {"lead": {}}}]}
    table = norms.norm_table(spark.createDataFrame([(json.dumps(data),)], "j string").select(F.from_json("j", norms.SCHEMA).alias("x")).select("x.*"))
    assert table.count() == 3
    people = [(1, "r1", "data", "entry", ["skills"], "SQL, git and latency"), (2, "r1", "data", "lead", ["summary"], ""), (3, "zz", "data", "lead", [], None), (4, "zz", "x", "lead", [], ""), (5, "r1", "data", "entry", ["projects", "skills"], "spark sql git rust latency cost vs x")]
    chosen = norms.chosen(spark.createDataFrame(people, "doc_id long, role string, family string, level string, kinds array<string>, text string"), table)
    assert {r.doc_id: (r.fit, r.norm_role, r.norm_level) for r in chosen.collect()} == {1: (0, "r1", "entry"), 2: (1, "r1", "entry"), 3: (2, "r2", "lead"), 4: (3, None, None), 5: (0, "r1", "entry")}
    got = {r.doc_id: tuple(r)[1:] for r in norms.alignment(chosen).collect()}
    assert got[1] == (0, 1, 2, 1, 1, 10 - 1.5 - 1.5 - 1 - 1) and got[3] == (2, 0, 0, 0, 0, 10.0) and got[4] == (3, 0, 0, 0, 0, 5.0) and got[5] == (0, 0, 0, 0, 0, 10.0)
    assert got[2] == (1, 2, 4, 2, 1, 10 - 3 - 3 - 1 - 1)
    pairs = lambda rows, name: spark.createDataFrame(rows, f"doc_id long, {name} string")
    told = norms.narrative(pairs([(1, "SQL"), (1, "Rust"), (1, "C"), (1, "Go")], "skill"), pairs([(1, "sql"), (1, "go"), (2, "iot")], "skill"), pairs([(1, "Soft"), (1, "Art"), (1, "X")], "category"), pairs([(1, "iot"), (2, "IoT")], "topic"))
    assert {r.doc_id: tuple(r)[1:] for r in told.collect()} == {1: (4, 2, 3, 1, 10 - 2.5 - 2 - 1)}


def test_knowledge_files(spark, tmp_path):
    (tmp_path / "role_norms").mkdir()
    files = {
        "role_norms/a.json": {"role_family": "data", "roles": [{"id": "r", "canonical_title": "Engineer", "seniority_levels": {"entry": {"expected_sections": ["skills"], "typical_tools": ["Spark", "SQL"], "anti_patterns": ["x", "y"]}}}]},
        "skill_relationships.json": {"skill_relationships": [{"source_skill": "SQL", "related": [{"skill": "Spark", "relation": "near", "transferability": 0.85, "rationale": "both query"}, {"skill": "Hive"}]}]},
        "writing_guidance.json": {"guidelines": [{"id": "g1", "title": "Say it", "summary": "Short.", "explanation": "Long.", "good_example": "Did"}, {"id": "g2", "title": "T", "summary": "S", "explanation": "E"}]},
        "project_archetypes.json": {"project_archetypes": [{"id": "p1", "title": "Search", "difficulty": "hard", "gap_skills": ["IR"], "suggested_stack": ["Spark"], "deliverables": ["code", "note"], "resume_bullet_template": "Built"}]},
    }
    for name, data in files.items():
        (tmp_path / name).write_text(json.dumps(data))
    got = {r.chunk_id: r for r in knowledge.corpus(spark, str(tmp_path)).collect()}
    assert set(got) == {"norm_r_entry", "skill_rel_sql_spark", "skill_rel_sql_hive", "g1", "g2", "p1"}
    assert got["norm_r_entry"].text == "Role: Engineer (Entry Level). Expected sections: skills. Typical tools: Spark, SQL. Expected metrics: . Anti-patterns: x; y."
    assert got["norm_r_entry"].title == "Engineer (Entry Norms)" and got["norm_r_entry"].metadata["role_family"] == "data"
    assert got["skill_rel_sql_spark"].text == "Skill relationship: SQL relates to Spark (near, transferability 85%). Rationale: both query" and "70%" in got["skill_rel_sql_hive"].text
    assert got["g1"].text == "Say it: Short. Long. Good example: Did" and got["g2"].text == "T: S E"
    assert got["p1"].text.startswith("Project: Search (Difficulty: hard). Gap skills addressed: IR. Suggested stack: Spark. Deliverables: code; note.")


def test_sql_functions_agree_with_columns(spark):
    assert set(sql.register(spark)) == set(sql.register(spark))
    texts = ["Saved $1,200 in May 2020 - June 2021", "Responsible for various, several things", "Launched it, reducing cost", "was reviewed by them", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows.createOrReplaceTempView("said")
    t = F.coalesce("text", F.lit(""))
    want = rows.select(t.rlike(statements.METRIC), F.regexp_count(t, F.lit(statements.VAGUE)).cast("long"), t.rlike(statements.WEAK_OPENERS), t.rlike(wording.PASSIVE), wording.verb_tier(F.col("text")), entries.find_dates(F.col("text"))).collect()
    got = spark.sql("SELECT has_metric(text), n_vague(text), weak_opener(text), is_passive(text), verb_tier(text), found_dates(text) FROM said ORDER BY doc_id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert spark.sql("SELECT calibrated(0.7, 0.4, 1.0)").first()[0] == spark.range(1).select(semantic.calibrated(F.lit(0.7), 0.4, 1.0)).first()[0]
    posts = spark.createDataFrame([(1, 0, 3), (1, 2, 9), (1, 14, 15), (1, 16, 20), (1, 30, None), (1, 28, 28), (2, 5, 6)], "owner long, start long, `end` long")
    posts.createOrReplaceTempView("posts")
    gaps = spark.sql("SELECT * FROM timeline_gaps(TABLE(posts) PARTITION BY owner ORDER BY (start, `end`), 3)")
    assert sorted(gaps.collect()) == sorted(intervals.gaps(posts.dropna(), 3).collect()) == [(1, 10, 13, 4), (1, 21, 27, 7)]
    found = spark.sql("SELECT doc_id, signal, n FROM signal_findings(TABLE(said))").collect()
    assert sorted(found) == sorted(reports.signal_findings(rows, list(reports.SIGNALS)).select("doc_id", "signal", "n").collect())


def event(job: str, status: str, minute: int, kind: str = "grade", **more) -> dict:
    return {"job_id": job, "kind": kind, "status": status, "at": f"2026-01-01T00:{minute:02d}:00.000Z", **more}


@pytest.mark.parametrize("status, wanted, told", [(None, "queued", "queued"), (None, "done", None), ("queued", "running", "running"), ("queued", "done", None), ("running", "done", "done"), ("done", "running", None), ("expired", "done", None)])
def test_moves(status, wanted, told):
    at = datetime(2026, 1, 1)
    state = (status, at, 0.5, "grade") if status else None
    new, said = lifecycle.moved(state, {"kind": "grade", "status": wanted, "at": at, "progress": None, "result": None}, {"grade"})
    assert (said and said["status"]) == told and (new[0] if new else None) == (told or status)


def test_jobs_go_on_after_a_restart(spark, tmp_path):
    paths = {"path": str(tmp_path / "in"), "out": str(tmp_path / "out"), "checkpoint": str(tmp_path / "check")}
    (tmp_path / "in").mkdir()

    def step(name: str, events: list[dict]) -> dict:
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(map(json.dumps, events)))
        lifecycle.follow(spark, paths["path"], ["grade"], paths["out"], paths["checkpoint"], allowed="5 minutes", late="0 seconds").awaitTermination()
        return {r.job_id: (r.status, r.progress) for r in lifecycle.latest(spark.read.parquet(paths["out"])).collect()}

    first = step("a", [event("j1", "queued", 0), event("j1", "running", 1, progress=0.25), event("j2", "queued", 1), event("j3", "queued", 1, kind="odd"), event("j4", "done", 1), event("j5", "queued", 0), event("j5", "running", 1)])
    assert first == {"j1": ("running", 0.25), "j2": ("queued", 0.0), "j3": ("failed", 0.0), "j5": ("running", 0.0)}
    second = step("b", [event("j1", "done", 3, result="A"), event("j1", "running", 4), event("j2", "running", 4), event("j3", "done", 4)])
    assert second["j1"] == ("done", 1.0) and second["j2"][0] == "running" and second["j3"][0] == "failed"
    third = step("c", [event("j6", "queued", 30)])
    third = step("d", [event("j6", "running", 31)])
    assert third["j5"][0] == "expired" and third["j2"][0] == "expired" and third["j1"][0] == "done"
    assert spark.read.parquet(paths["out"]).groupBy("job_id", "status", "at").count().filter("count > 1").count() == 0
