"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from repolumen import registry
from tests.compare import connect, differences

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


registry.load_all()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    problem = differences(contract.queries()[name](spark, SF_DIR), con, contract.oracle_sql()[name])
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_recall_of_probed_cells(spark):
    row = contract.queries()["q4_recall"](spark, SF_DIR).head()
    assert row["found_hits"] <= row["exact_hits"] and row["recall"] >= 0.9


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["qid", "rank", "id", "repo_name", "score", "content"] and df.count() > 0
