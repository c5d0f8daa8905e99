"""Every registered query of the reference's operators against its SQL, at the smallest scale."""

import pytest
from conftest import compare

from lodepath.plans.all_queries import ORACLES, QUERIES


#: Queries without SQL that find nothing in the smallest tables; their operators are held against plain loops elsewhere.
FEW = {"connector_floors", "floor_changes", "tap_synchronisation"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    if name in ORACLES:
        compare(spark, duck, QUERIES[name], ORACLES[name], sf_dir)
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0 or name in FEW


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_hides_no_real_errors():
    import __spark_entry__ as e

    for error, hidden in ((ModuleNotFoundError("x", name="lodepath.llm"), True), (ModuleNotFoundError("x", name="corpus_pipeline"), True), (ImportError("cannot import name", name="lodepath.llm.common"), False), (ModuleNotFoundError("x", name="lodepath.llm.common"), False), (ImportError("x", name="lodepath.llm"), False)):
        assert e.absent(error) == hidden
