from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from papyrine.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("papyrine-tests", master="local[4]", shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
