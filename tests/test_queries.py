"""Every registered query against its SQL on the smallest tables."""

import pytest

from check_oracles import compare, duck
from perfloom.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    got = q.run(spark, FOLDER).toPandas()
    problem = compare(got, con.execute(q.oracle()).df())
    assert problem is None, problem


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
