"""What keeps the text and plan queries linear: each text is read once, behind the spreading of
rows, a few at a time, and only for what is asked for."""

import pyarrow as pa
import pytest

from tessera import arrays
from tessera.operators import generated
from tessera.plans import tables

SPREAD_ONCE = "plan_nodes plan_props plan_advice plan_advice_canonical plan_advice_blocks".split()


def planned(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", SPREAD_ONCE)
def test_texts_are_read_once_and_spread_before(spark, tiny, name):
    plan = planned(generated.QUERIES[name](spark, tiny))
    assert plan.count("EvalPython") == 1
    assert plan.index("EvalPython") < plan.index("Exchange RoundRobinPartitioning")


@pytest.mark.parametrize("name", ["plan_diff", "plan_same_structure"])
def test_pairs_read_each_capture_once(spark, tiny, name):
    assert planned(generated.QUERIES[name](spark, tiny)).count("EvalPython") == 1


def test_rows_of_plans_hold_only_what_is_asked_for(spark):
    rows = spark.createDataFrame([(1, " Seq Scan on t\n   Filter: a")], "plan_id bigint, text string")
    assert "props" not in tables.parse_plans(rows, parts=("nodes",)).select("parsed.*").columns
    assert tables._read(" Seq Scan on t\n   Filter: a", ("props",))[5:] == ([], [(0, 0, "Filter: a", "Filter", "a", "expression", [("Filter", "a")])], ())


def test_few_texts_are_python_objects_at_once(monkeypatch):
    seen = []
    monkeypatch.setattr(tables, "_chunk", lambda some, parts, kind, was=tables._chunk: seen.append(len(some)) or was(some, parts, kind))
    ddl = tables.parsed_type(("props",))
    out = arrays.chunked(pa.array([" Seq Scan on t\n   Filter: a"] * 1200), tables.CHUNK, lambda some, kind: tables._chunk(some, ("props",), kind), ddl)
    assert seen == [500, 500, 200] and len(out) == 1200 and out[1199].as_py()["props"][0]["raw"] == "Filter: a"


def test_diff_keeps_a_full_join_by_kind(spark):
    texts = spark.createDataFrame([(1, " Seq Scan on t"), (2, " Seq Scan on u"), (3, "")], "plan_id bigint, text string")
    pairs = spark.createDataFrame([(7, 1, 2), (8, 1, 3), (9, 1, 1), (None, 1, 1)], "pair_id bigint, before_id bigint, after_id bigint")
    rows = {(r.pair_id, r.kind, r.before, r.after) for r in tables.plan_diff(tables.parse_plans(texts), pairs).collect()}
    kinds = ("JOIN_ORDER", "SEQ_SCAN", "NO_GATHER")
    want = {(7, k, f"{k}(t)", f"{k}(u)") for k in kinds} | {(8, k, f"{k}(t)", None) for k in kinds}
    assert rows == want | {(None, k, f"{k}(t)", None) for k in kinds} | {(None, k, None, f"{k}(t)") for k in kinds}
