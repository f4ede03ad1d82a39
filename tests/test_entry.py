from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'])"


def asked(folder: Path) -> str:
    return subprocess.run([sys.executable, "-c", ASK], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout


def test_the_rest_works_without_llm(tmp_path):
    folder = tmp_path / "repo"
    shutil.copytree(REPO, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "*.parquet"))
    assert asked(folder).rstrip().endswith("[]")
    (folder / "papyrine/llm").mkdir()
    assert asked(folder).rstrip().endswith("[]")


def test_every_sql_belongs_to_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_llm_is_imported_by_nothing_else():
    for path in REPO.glob("papyrine/**/*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"papyrine\.llm|from papyrine import llm", path.read_text()), path


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
