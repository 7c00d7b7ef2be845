"""Each script is lexed once, behind the spreading of rows."""

import pytest

from tessera.functions import sql
from tessera.operators import generated


@pytest.mark.parametrize("name", ["sql_tokens", "statement_kinds", "script_statements"])
def test_scripts_are_read_once_and_spread_before(spark, tiny, name):
    plan = generated.QUERIES[name](spark, tiny)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("EvalPython") == 1
    assert plan.index("EvalPython") < plan.index("Exchange RoundRobinPartitioning")


def test_tokens_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "select 'open"), (4, "-- only"), (5, "a -- b")], "path bigint, text string")
    found = {(r.path, r.stmt_no, r.ord, r.text, r.trailing_comment) for r in sql.sql_tokens(rows).collect()}
    assert found == {(4, -1, 0, "-- only", None), (5, 0, 0, "a", "-- b")}
