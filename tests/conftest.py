import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from repolith.session import local_session, ship

    s = local_session(4, 4, "3g")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s


@pytest.fixture(params=["keys fit", "keys are split"])
def sizes(request, monkeypatch):
    """Run a test with plain windows and with keys cut into buckets."""
    from repolith.operators import ordered

    if request.param == "keys are split":
        monkeypatch.setattr(ordered, "MOST", 0)
