import subprocess
import sys

import pytest
from check_sql import compare, connect

import __spark_entry__ as contract
from lumisift.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    result = compare(spark, con, SF, name, contract.queries()[name], contract.oracle_sql().get(name))
    assert result.startswith("ok" if name in catalog.SQL else "rows="), result


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_the_rest_works_without_the_corpus_part():
    code = ("import sys; sys.modules['lumisift.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
            "from lumisift.plans import catalog as c; assert e.queries() == c.QUERIES and e.oracle_sql() == c.SQL")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=contract.__file__.rsplit("/", 1)[0])
