import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelwright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Small inputs would be coalesced into one block; keep several.
    session = local_session("tests", cores="8", **{"spark.sql.adaptive.coalescePartitions.enabled": "false"})
    yield session
    session.stop()
