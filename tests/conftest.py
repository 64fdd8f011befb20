from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quillstone.session import session

    found = session("local[4]", partitions=4, memory="3g")
    yield found
    found.stop()
