"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import pytest

from cairn.plans.queries import ORACLE_SQL, QUERIES
from tests_support import db, rows_of


@pytest.fixture(scope="module")
def connection():
    return db.connection()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, connection, name):
    got = QUERIES[name](spark, db.folder)
    want = connection.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())
