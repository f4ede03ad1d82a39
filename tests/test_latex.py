"""Macros, their nested arguments and lines, hidden text, and rows of a document."""

from __future__ import annotations

from papyrine.sources import documents, latex

SOURCE = r"""\documentclass{cv} % \section{no}
\section*{Work \textbf{\emph{at} all}}
\cventry{2019 -- 2021}{Clerk | Files, \textit{Ink}}
  {Acme}{Rome} % {not this}
\begin{itemize}
\item Saved \$5 at 10\% {\bf of {all}}
\item \textcolor{white}{Java \emph{Rust}}
\end{itemize}
\fontsize{1}{1}{tiny words}\phantom{ghost} \textcolor{red}{seen}
Stray } and { open
\subsection{Study}
\degree{Maths}

{apart}"""


def test_events_and_model(spark, tmp_path):
    (tmp_path / "a.tex").write_text(SOURCE)
    (tmp_path / "b.tex").write_text("no macros")
    docs = documents.text_files(spark, str(tmp_path)).selectExpr("substring_index(doc_id, '/', -1) AS doc_id", "text", "1 AS line")
    found = latex.events(docs)
    got = [(r.line, r.kind, r.name, r.text, list(r.args)) for r in found.orderBy("i").collect()]
    assert got == [
        (2, "heading", "\\section*", "Work at all", ["Work at all"]),
        (3, "entry", "\\cventry", "2019 -- 2021", ["2019 -- 2021", "Clerk | Files, Ink", "Acme", "Rome"]),
        (6, "item", "\\item", "Saved $5 at 10% of all", ["Saved $5 at 10% of all"]),
        (7, "item", "\\item", "whiteJava Rust", ["whiteJava Rust"]),
        (7, "hidden", "\\textcolor", "Java Rust", ["white", "Java Rust"]),
        (9, "hidden", "\\fontsize", "tiny words", ["1", "1", "tiny words"]),
        (9, "hidden", "\\phantom", "ghost", ["ghost"]),
        (11, "heading", "\\subsection", "Study", ["Study"]),
    ]
    rows = latex.model(found).collect()
    entry = next(r for r in rows if r.kind == "entry")
    assert (entry.line_id, entry.section, entry.entry, entry.title, entry.tags, entry.dates, entry.subtitle) == ("t3", 1, 1, "Clerk", "Files, Ink", "2019", "Acme") or entry.dates == "2019 – 2021"
    assert [r.line_id for r in rows if r.line_id.startswith("t7") or r.line_id.startswith("t9")] == ["t7", "t7a", "t9", "t9a"]


def test_odd_sources(spark):
    odd = [("a", None), ("b", ""), ("c", "}}}{{{"), ("d", "\\section{open"), ("e", "{" * 300 + "x" + "}" * 300), ("f", "\\section{A}\\section{B}"), ("g", "\\x{a}{b}" * 200)]
    got = latex.events(spark.createDataFrame(odd, "doc_id string, text string")).collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r.doc_id, []).append((r.kind, r.text))
    assert kinds == {"f": [("heading", "A"), ("heading", "B")], "g": [("entry", "a")] * 200}


def test_sources_are_not_shuffled(spark):
    docs = spark.range(4).selectExpr("id AS doc_id", r"'\\\\x{a}{b}' AS text")
    plan = latex.events(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan
    assert latex.matched("\\x{a}[o] {\\y{b}{c}}\n\n{d}") == [(0, "\\x", 1, False, [(1, 3), (5, 13)]), (6, "\\y", 1, True, [(7, 9), (10, 12)])]
