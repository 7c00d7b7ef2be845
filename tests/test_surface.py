import pytest

from tessera.operators import surface, text_queries

from .oracle import same

QUERIES = surface.queries() | text_queries.queries()
ORACLES = surface.oracle_sql() | text_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tiny, name):
    same(QUERIES[name](spark, tiny), ORACLES[name], tiny)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, tiny, name):
    assert QUERIES[name](spark, tiny).collect()


def test_scan_is_pruned_and_pushed_down(spark, tiny):
    plan = QUERIES["scan_filter_project"](spark, tiny)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "PushedFilters: [IsNotNull(" in plan and "l_returnflag" not in plan and "l_partkey" not in plan
