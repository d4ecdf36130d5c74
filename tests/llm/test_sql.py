"""Queries of the optional package against their SQL, on the driver's smallest tables."""

from pathlib import Path

import pytest

from alarmlens.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no driver tables here")
check = pytest.importorskip("check")


def test_sql_belongs_to_queries():
    assert ORACLE.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_as_sql(spark, name):
    assert check.compare(spark, check.connect(FOLDER), FOLDER, name) == ""
