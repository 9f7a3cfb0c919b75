"""Every query with SQL gives the rows of its SQL; every other gives rows."""

import pytest

from tests import oracle
from tests.conftest import DATA
from weftline.plans import catalogue


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name not in catalogue.SQL:
        assert len(ours)
        return
    theirs = duck.execute(catalogue.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert oracle.rows(ours) == oracle.rows(theirs)
