import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from furlong.plans import catalog
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES, ORACLES) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 41 and df.count() > 0


def test_entry_works_without_the_text_operators():
    code = "import sys; sys.modules['furlong.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
