import pytest

from lodestream.plans import core, evaluation, nested, preference
from tests.compare import both
from tests.conftest import DATA


MODULES = {n: m for m in (core, preference, evaluation) for n in m.oracle_sql()}


@pytest.mark.parametrize("name", sorted(MODULES))
def test_query_equals_sql(spark, name):
    got, want = both(spark, MODULES[name].queries()[name], MODULES[name].oracle_sql()[name], DATA)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert core.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert "p3_found" in nested.queries()
