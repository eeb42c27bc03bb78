from __future__ import annotations

import pytest

from watchloom.session import local_session

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def folder():
    return FOLDER
