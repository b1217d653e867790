from __future__ import annotations

import pytest

from .oracle import session


@pytest.fixture(scope="session")
def spark():
    made = session()
    yield made
    made.stop()
