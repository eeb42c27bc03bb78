"""Every registered query against its DuckDB twin, on the smallest folder."""

from __future__ import annotations

import pytest

from tests.oracle import connect, differences
from watchloom.plans import catalog

catalog.load_all()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


# Queries that share their operators and twins with others of the list are left to `python -m tests.oracle`.
SLOW = {"incident_json", "recent_incidents", "traffic_exfil_volume_anomaly", "traffic_bruteforce_warmup", "traffic_exfil_large_transfer"}


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in SLOW])
def test_query(spark, con, folder, name):
    rows, problem = differences(spark, con, name, folder)
    assert not problem, problem
    assert rows > 0 or name == "extract_hashes"


def test_every_query_reads_tables_and_most_have_twins():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) - set(catalog.ORACLES) <= {"forest_train_score", "observe"}
