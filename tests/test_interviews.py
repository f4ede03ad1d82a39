"""Plans, evidence and scores of interviews, and claims against repositories, with pinned results."""

from __future__ import annotations

from papyrine.operators import claims, interview

STATEMENTS = [
    (1, "experience", "e1", "s1", 1, "Built an invoice service for 3 finance teams.", "B", True), (1, "experience", "e1", "s2", 2, "Cut report time from 40 to 5 minutes by caching queries.", "A", True),
    (1, "experience", "e1", "s3", 3, "Helped with testing.", "D", False), (1, "projects", "e2", "s4", 4, "Implemented leader election in Go.", "C", False), (1, "skills", "e3", "s5", 5, "Python, Go", None, None),
]
SCHEMA = "doc_id long, kind string, entry string, id string, ord long, text string, grade string, has_metric boolean"


def test_plan(spark):
    rows = spark.createDataFrame(STATEMENTS, SCHEMA)
    strongest = interview.claims(rows)
    assert [r.id for r in strongest.orderBy("n").collect()] == ["s2", "s1", "s4", "s3"]
    texts = lambda x: spark.createDataFrame(x, "doc_id long, text string, ord long")
    people = spark.createDataFrame([(1,), (2,)], "doc_id long")
    asked = interview.plan(strongest, texts([(1, "Kubernetes", 1), (1, "APIs", 2), (1, "more", 3)]), texts([(1, "Obsession", 1)]), texts([(1, "Data", 1), (1, "Pace", 2)]), people)
    got = [(r.doc_id, r["round"], r.n, r.probes, r.why) for r in asked.collect()]
    assert sorted(got) == [
        (1, 1, 1, "s2", "claim"), (1, 1, 2, "s1", "claim"), (1, 1, 3, "s4", "claim"), (1, 2, 1, "Kubernetes", "requirement"), (1, 2, 2, "APIs", "requirement"), (1, 3, 1, "Obsession", "value"), (1, 3, 2, "Data", "signal"),
        (2, 3, 1, "general", "general"),
    ]


def test_evidence(spark):
    rows = spark.createDataFrame(STATEMENTS, SCHEMA)
    questions = spark.createDataFrame([(1, "q1", "s3", "x"), (1, "q2", "none", "Which report or service took much time in Python?"), (1, "q3", None, "zzz")], "doc_id long, question string, probes string, text string")
    got = {}
    for r in interview.evidence(questions, rows).orderBy("question", "place").collect():
        got.setdefault(r.question, []).append(r.text)
    assert got == {"q1": [s[5] for s in STATEMENTS[:3]], "q2": [STATEMENTS[1][5], "Python, Go", STATEMENTS[0][5]]}


def test_final_scores(spark):
    answer = "At Acme our finance reports took 40 minutes. I was responsible for making them faster. I profiled the slow queries and added a cache. Report time fell to 5 minutes for 3 teams, and we saved 20 hours a month."
    answers = spark.createDataFrame([("s", "q", answer), ("s", "r", None)], "session_id string, question_id string, answer string")
    labels = [("s", "q", "situation", True, "At Acme our finance  reports took 40 minutes.", 8.0), ("s", "q", "task", True, "I was responsible for making them faster.", 6.0), ("s", "q", "action", True, "I rewrote the whole system in Rust.", 10.0), ("s", "q", "result", True, "Report time fell to 5 minutes for 3 teams", 10.0)]
    frame = spark.createDataFrame(labels, "session_id string, question_id string, part string, present boolean, quote string, score double")
    parts = {r.part: (r.verified, r.score) for r in interview.parts_scored(answers, frame).collect()}
    assert parts["action"] == (False, 3.0) and parts["result"] == (True, 10.0)
    ground = spark.createDataFrame([("s", "q", STATEMENTS[0][5]), ("s", "q", STATEMENTS[1][5])], "session_id string, question_id string, text string")
    got = {r.question_id: (r.overall, r.unverified) for r in interview.final_scores(answers, frame, ground).collect()}
    assert got == {"q": (66.5, [20.0]), "r": (0.0, [])}


def test_claims_against_repositories(spark):
    projects = spark.createDataFrame([
        (1, "p1", "AshaR", "Invoice API | FastAPI, PostgreSQL, Redis", "Built a FastAPI service on PostgreSQL with Redis caching.", 2024 * 12),
        (1, "p2", "ashar", "raft-kv", "Leader election in Go; see github.com/ashar/raft-kv.git", 2023 * 12 + 5), (1, "p3", "ashar", "Secret project", "Trained models in PyTorch.", None), (1, "p4", "ashar", "x", "github.com/other/tool in Go", None), (1, "p5", "ashar", "y", "github.com/gone/none in Go", None),
    ], "doc_id long, entry_id string, username string, title string, text string, start int")
    repos = spark.createDataFrame([
        ("ashar", "invoice-api", "ashar/invoice-api", "ashar", False, "2024-09-01T00:00:00Z", "", ["fastapi"]), ("ashar", "raft-kv", "ashar/raft-kv", "ashar", True, "2023-05-01T00:00:00Z", None, []), ("other", "tool", "other/tool", "other", False, None, "a go tool", None),
    ], "username string, name string, full_name string, owner string, fork boolean, created_at string, description string, topics array<string>")
    languages = spark.createDataFrame([("ashar/invoice-api", "Python"), ("ashar/raft-kv", "Go")], "full_name string, language string")
    files = spark.createDataFrame([("ashar/invoice-api", "requirements.txt", "fastapi==0.115\npsycopg2-binary\n"), ("ashar/invoice-api", "notes.txt", "redis")], "full_name string, path string, content string")
    names = spark.createDataFrame([("fastapi", "FastAPI"), ("postgresql", "PostgreSQL"), ("redis", "Redis"), ("go", "Go"), ("pytorch", "PyTorch"), ("github", "GitHub")], "phrase string, canonical string")
    checks = claims.checked(projects, repos, claims.evidence(repos, languages, files, names), names)
    got = {r.entry_id: tuple(r)[2:] for r in checks.collect()}
    assert got == {
        "p1": ("name", "ashar/invoice-api", ["FastAPI", "PostgreSQL"], ["Redis"], True, False, False, True), "p2": ("url", "ashar/raft-kv", ["Go"], [], True, True, False, False),
        "p3": ("none", None, [], [], False, False, False, False), "p4": ("url", "other/tool", ["Go"], [], True, False, True, False), "p5": ("url", "gone/none", [], [], False, False, False, False),
    }
    three = checks.filter("entry_id in ('p1', 'p2', 'p3')")
    assert [tuple(r) for r in claims.verification(three).collect()] == [(1, 3, 2, 4, 75.0)]
