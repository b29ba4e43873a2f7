"""Every registered query against its DuckDB oracle (the driver's check),
run on the smallest scale so the suite stays quick; the driver repeats it
at sf0.01. Queries without an oracle are checked to run."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from hourbook.plans.catalog import QUERIES as TRACKER
from oracle_compare import compare, duck

QUERIES = E.queries()
SQL = E.oracle_sql()
# Optional operators that SQL can't express have tests of their own.
NAMES = sorted(n for n in QUERIES if n in SQL or n in TRACKER)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["groupBy", "timeSpentHrs"] and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    if name not in SQL:
        QUERIES[name](spark, SF_SMALL).count()
        return
    problems, n, _, _ = compare(spark, con, name, QUERIES[name], SQL[name], SF_SMALL)
    assert not problems, problems
