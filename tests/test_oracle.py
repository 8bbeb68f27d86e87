"""Every registered query against its check SQL."""

import pytest
from compare import connect, difference

from __spark_entry__ import entry
from phrasemill.plans.oracle import ORACLE
from phrasemill.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    with connect(SF) as c:
        yield c


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).columns == ["example_id", "input", "output_json"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE[name]) == ""
