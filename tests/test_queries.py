"""Every named query against its SQL oracle on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry_points
from tallyspark.plans import QUERIES
from tests.oracle import compare, connect

FOLDER = entry_points.SMOKE_FOLDER
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    frame = entry_points.queries()[name](spark, FOLDER)
    assert compare(frame, database, entry_points.oracle_sql()[name]) is None
