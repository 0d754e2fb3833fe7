import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from talkloom.session import build_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__driver__memory="4g",
        spark__sql__shuffle__partitions="4",
        spark__sql__execution__arrow__maxRecordsPerBatch="500",
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session, ROOT, ["talkloom", "suite"])
    yield session
    session.stop()
