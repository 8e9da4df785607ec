import pytest

from kelpwork.llm import queries
from tests.compare import DATA, both


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    got, want = both(spark, queries.QUERIES[name], queries.ORACLE[name])
    assert got == want


@pytest.mark.parametrize("name", ["p1_sample", "p5_assignment", "p5_balance"])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
