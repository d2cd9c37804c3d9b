"""Every registered query of the survey operators beside its SQL, at the smallest size."""

import pytest

from tessera.queries import QUERIES
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
#: Queries that show nothing at this size: no level is frequent enough for the threshold.
EMPTY = {"frequency_table"}


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, connection, name):
    assert compare(spark, connection, name, FOLDER) == ("no rows" if name in EMPTY else None)


def test_slots_and_items_cover_the_data(connection):
    from tessera.queries.wide import EVENT_TYPES, SLOTS

    assert connection.execute("SELECT max(l_linenumber) FROM lineitem").fetchone()[0] <= max(SLOTS)
    seen = connection.execute("SELECT DISTINCT event_type FROM events").fetchall()
    assert {t for (t,) in seen} <= set(EVENT_TYPES)
