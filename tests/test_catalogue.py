"""Every query of the catalogue against its SQL, on the driver's smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from catalogue.oracle import ORACLE
from catalogue.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no driver tables here")
check = pytest.importorskip("check")


@pytest.fixture(scope="module")
def connection():
    return check.connect(FOLDER)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= contract.queries().keys() and contract.oracle_sql().keys() <= contract.queries().keys()


def test_entry(spark):
    assert contract.entry(spark).count() == 44


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, connection, name):
    assert check.compare(spark, connection, FOLDER, name) == ""
