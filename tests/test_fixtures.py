"""The smallest tables hold every special case that FIXTURES.md names, so the tests see them all."""

import pytest
from conftest import SMALL
from testbed.compare import database
from testbed.oracle import CTES

CASES = {
    "a session without an id in hits": "SELECT 1 FROM access WHERE session_id = '-' AND shape < 5",
    "runtime lines without a session id": "SELECT 1 FROM other_runtime WHERE session = '-' AND shape = 0",
    "repeated lines": "SELECT 1 FROM lines GROUP BY ALL HAVING count(*) > 1",
    "an object that is no number": "SELECT 1 FROM runtime WHERE message LIKE '%[x, %'",
    "an object beyond 64 bits": "SELECT 1 FROM access WHERE clicked_oid IS NULL",
    "a day that does not exist": "SELECT 1 FROM lines WHERE et = 'error' AND m = 8",
    "a line of no shape": "SELECT 1 FROM lines WHERE et = 'error' AND m = 7",
    "a page of two names": "SELECT 1 FROM site_pages GROUP BY page_id HAVING count(*) > 1",
    "a column of two tables": "SELECT 1 FROM site_attributes GROUP BY entity_id, attribute_id HAVING count(DISTINCT table_db) > 1",
    "an entity of two names": "SELECT 1 FROM site_attributes GROUP BY entity_id HAVING count(DISTINCT entity_name) > 1",
    "a dumped object of two names": "SELECT 1 FROM part WHERE p_partkey % 10 = 1",
    "a page that the model does not know": "SELECT 1 FROM hits WHERE requested_page_id NOT IN (SELECT page_id FROM site_pages)",
    "a link that the model does not know": "SELECT 1 FROM hits WHERE clicked_link_id NOT IN (SELECT link_id FROM site_links)",
    "a value that the dumps do not have": "SELECT 1 FROM valued_shown WHERE displayed_oid_value IS NULL",
    "a click within a page": "SELECT 1 FROM hits WHERE source_page_id = requested_page_id",
    "a visit with a next page": "SELECT 1 FROM next_page",
    **{f"access shape {s}": f"SELECT 1 FROM access WHERE shape = {s}" for s in range(1, 6)},
    **{f"runtime shape {s}": f"SELECT 1 FROM runtime WHERE shape = {s}" for s in range(1, 5)},
}


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("case", CASES)
def test_tables_hold(con, case):
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in CTES.items())
    assert con.execute(f"WITH {ctes} {CASES[case]} LIMIT 1").fetchall(), case
