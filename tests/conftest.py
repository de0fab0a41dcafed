"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from rillwave.session import build_session, ship_package

    session = build_session("tests", "local[4]", 4, **{"spark.driver.memory": "4g", "spark.ui.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()
