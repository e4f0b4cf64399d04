from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from examlens.session import local_session  # noqa: E402

# needs the published panel, which is not part of this repository; refits in numpy are in
# test_regressions.py, test_forecast.py and test_guards.py
collect_ignore = [] if os.environ.get("EXAMLENS_GOLDEN_PANEL") else ["test_golden_panel.py"]

SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def small_dir():
    if not SMALL.exists():
        pytest.skip("test tables are not on this machine")
    return str(SMALL)
