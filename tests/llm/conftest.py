from __future__ import annotations

import pytest

from watchloom.session import configure


@pytest.fixture(scope="session")
def session(spark):
    return configure(spark)
