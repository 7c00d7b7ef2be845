import json

import pytest

from tessera.plans import advice, diff, jsonplan, props, reflow, tables, tree


def lines(text):
    return [str(a) for a in advice.derive(tree.parse(text))]


JOIN = """ {join}
   ->  Seq Scan on a
   ->  {inner}
         ->  Seq Scan on b
"""


@pytest.mark.parametrize(
    "join, inner, want",
    [
        ("Hash Join", "Hash", "HASH_JOIN(b)"),
        ("Hash Right Anti Join", "Hash", "HASH_JOIN(b)"),
        ("Merge Join", "Sort", "MERGE_JOIN_PLAIN(b)"),
        ("Merge Left Join", "Materialize", "MERGE_JOIN_MATERIALIZE(b)"),
        ("Nested Loop", "Materialize", "NESTED_LOOP_MATERIALIZE(b)"),
        ("Nested Loop Semi Join", "Memoize", "NESTED_LOOP_MEMOIZE(b)"),
        ("Nested Loop", "Sort", "NESTED_LOOP_PLAIN(b)"),
    ],
)
def test_join_methods(join, inner, want):
    assert lines(JOIN.format(join=join, inner=inner))[1] == want


def test_bushy_order_self_join_and_gather():
    text = """ Gather
   ->  Hash Join
         ->  Seq Scan on t
         ->  Hash
               ->  Nested Loop
                     ->  Seq Scan on t
                     ->  Index Scan using u_pkey on u x
"""
    assert lines(text) == ["JOIN_ORDER(t (t#2 x))", "NESTED_LOOP_PLAIN(x)", "HASH_JOIN((t#2 x))", "SEQ_SCAN(t t#2)", "INDEX_SCAN(x u_pkey)", "GATHER((t t#2 x))"]


def test_bitmap_index_scan_is_no_relation():
    text = """ Bitmap Heap Scan on t
   ->  BitmapOr
         ->  Bitmap Index Scan on t_a
         ->  Bitmap Index Scan on t_b
"""
    root = tree.parse(text).root
    assert [n.type for n in root.walk()] == ["bitmap-heap-scan", "bitmap-or", "bitmap-index-scan", "bitmap-index-scan"]
    assert lines(text) == ["JOIN_ORDER(t)", "BITMAP_HEAP_SCAN(t)", "NO_GATHER(t)"]


@pytest.mark.parametrize("label", ["HashSetOp Intersect", "SetOp Except All", "HashSetOp Intersect All", "SetOp Except"])
def test_set_operations_keep_their_label(label):
    assert tree.classify(label)[0] == "set-op" and tree.classify(label)[2] == label


def test_prefixes_nest_and_unknown_nodes_stay():
    assert tree.classify("Finalize Parallel HashAggregate")[:2] == ("hash-aggregate", ["Finalize", "Parallel"])
    assert tree.classify("Custom Scan (Citus)")[0] == "custom-scan"
    assert tree.classify("Mystery Node on x")[0] == "unknown"


def test_costs_off_analyze_fractions_never_executed():
    node = tree.node_of("Seq Scan on cars c (actual rows=1.50 loops=2)")
    assert (node.relation, node.alias, node.rows_actual, node.time_actual, node.loops) == ("cars", "c", 1.5, None, 2)
    assert tree.node_of("Seq Scan on cars (never executed)").never


def test_echoes_header_planning_block_and_footer():
    text = "SET\n                QUERY PLAN\n--------------------------\n Limit  (cost=0.00..1.00 rows=1 width=4)\n   ->  Seq Scan on t  (cost=0.00..9.00 rows=9 width=4)\n Planning:\n   Buffers: shared hit=4\n Planning Time: 1.5 ms\n(5 rows)\nmore"
    plan = tree.parse(text)
    assert [n.type for n in plan.root.walk()] == ["limit", "seq-scan"] and plan.planning_ms == 1.5 and not plan.root.props


def test_empty_plan_is_no_error_and_no_plan_is():
    assert tree.parse(" QUERY PLAN\n------------\n(0 rows)\n").empty
    with pytest.raises(tree.PlanError):
        tree.parse("\n\n")


def test_subplan_names_and_plan_level_lines():
    text = """ Seq Scan on t  (cost=0.00..1.00 rows=1 width=4)
   Filter: (a = (InitPlan 1).col1)
   InitPlan 1
     ->  Result  (cost=0.00..0.01 rows=1 width=4)
 Settings: work_mem = '1MB'
"""
    plan = tree.parse(text)
    assert plan.root.children[0].subplan == "InitPlan 1" and plan.extra == ["Settings: work_mem = '1MB'"]


def test_advice_blocks():
    text = """ Seq Scan on t
 Supplied Plan Advice:
   SEQ_SCAN(t) /* matched */
 Generated Plan Advice:
   JOIN_ORDER(t
     u)
   NO_GATHER(t)
"""
    plan = tree.parse(text)
    assert [(str(a), a.annotation) for a in plan.supplied] == [("SEQ_SCAN(t)", "matched")]
    assert [str(a) for a in plan.generated] == ["JOIN_ORDER(t u)", "NO_GATHER(t)"]


@pytest.mark.parametrize(
    "line, want",
    [
        ("Sort Method: quicksort  Memory: 25kB", {"Sort Method": "quicksort", "Sort Space Type": "Memory", "Sort Space Used": "25"}),
        ("Buckets: 1024 (originally 2048)  Batches: 1  Memory Usage: 44kB", {"Hash Buckets": "1024", "Original Hash Buckets": "2048", "Hash Batches": "1", "Peak Memory Usage": "44"}),
        ("Batches: 3  Memory Usage: 77kB  Disk Usage: 18kB", {"HashAgg Batches": "3", "Peak Memory Usage": "77", "Disk Usage": "18"}),
        ("Heap Blocks: exact=12 lossy=3", {"Exact Heap Blocks": "12", "Lossy Heap Blocks": "3"}),
        ("I/O Timings: shared read=1.5, temp write=0.2", {"Shared I/O Read Time": "1.5", "Temp I/O Write Time": "0.2"}),
        ("WAL: records=3 fpi=1 bytes=99", {"WAL Records": "3", "WAL FPI": "1", "WAL Bytes": "99"}),
        ("Estimates: capacity=8 distinct keys=4 lookups=10 hit percent=60.00%", {"Estimated Capacity": "8", "Estimated Distinct Lookup Keys": "4", "Estimated Lookups": "10", "Estimated Hit Percent": "60.00"}),
        ("Prefetch: avg=2.00 max=8 capacity=16", {"Average Prefetch Distance": "2.00", "Max Prefetch Distance": "8", "Prefetch Capacity": "16"}),
        ("Storage: Memory  Maximum Storage: 32kB", {"Storage": "Memory", "Maximum Storage": "32"}),
        ("Memory: used=120kB  allocated=256kB", {"Memory Used": "120", "Memory Allocated": "256"}),
        ("Full-sort Groups: 6  Sort Method: quicksort  Average Memory: 41kB  Peak Memory: 43kB", {"Full-sort Group Count": "6", "Full-sort Sort Methods Used": "quicksort", "Full-sort Average Sort Space Used": "41", "Full-sort Peak Sort Space Used": "43", "Full-sort Sort Space Type": "Memory"}),
        ("Filter: (a = 'b: c'::text)", {"Filter": "(a = 'b: c'::text)"}),
        ("My Extension: yes", {"My Extension": "yes"}),
    ],
)
def test_properties(line, want):
    assert props.parse_prop(line).fields == want


def test_text_and_json_give_the_same_decisions_and_properties():
    text = """ Hash Left Join  (cost=1.00..9.00 rows=9 width=4) (actual time=0.100..0.900 rows=9 loops=1)
   Hash Cond: (a.x = b.x)
   Buffers: shared hit=7 read=2
   ->  Seq Scan on a  (cost=0.00..2.00 rows=9 width=4) (actual time=0.010..0.100 rows=9 loops=1)
         Filter: (y > 1)
         Rows Removed by Filter: 3
   ->  Hash  (cost=0.00..1.00 rows=9 width=4) (actual time=0.010..0.200 rows=9 loops=1)
         Buckets: 1024  Batches: 1  Memory Usage: 9kB
         ->  Seq Scan on b  (cost=0.00..1.00 rows=9 width=4) (actual time=0.010..0.100 rows=9 loops=1)
 Planning Time: 0.200 ms
 Execution Time: 1.000 ms"""
    one = tree.parse(text)
    two = jsonplan.parse_json(jsonplan.to_json(one))
    assert [str(a) for a in advice.derive(one)] == [str(a) for a in advice.derive(two)]
    assert [(n.title, n.props, n.rows_actual) for n in one.root.walk()] == [(n.title, n.props, n.rows_actual) for n in two.root.walk()]
    assert two.execution_ms == 1.0 and diff.changes(one, two) == []
    assert json.loads(jsonplan.to_json(one))[0]["Plan"]["Join Type"] == "Left"


@pytest.mark.parametrize("text", ["", "[]", "{}", "[1]", "not json"])
def test_json_without_plan(text):
    with pytest.raises(tree.PlanError):
        jsonplan.parse_json(text)


@pytest.mark.parametrize(
    "line, want",
    [
        ("SEQ_SCAN(z public.a)", "SEQ_SCAN(a z)"),
        ("JOIN_ORDER(z (y s.x))", "JOIN_ORDER(z (y x))"),
        ("INDEX_SCAN(b s.b_i a s.a_i)", "INDEX_SCAN(a a_i b b_i)"),
        ("INDEX_SCAN(b i a)", "INDEX_SCAN(b i a)"),
        ("GATHER((z y) x)", "GATHER((y z) x)"),
        ('SEQ_SCAN("a.b" s."c d")', 'SEQ_SCAN("a.b" "c d")'),
    ],
)
def test_canonical(line, want):
    once = advice.canonical(tree.parse_advice_line(line))
    assert str(once) == want and str(advice.canonical(once)) == want


def test_unified_diff_text():
    a = tree.parse(" Seq Scan on w  (cost=0.00..7.00 rows=2 width=9)\n Planning Time: 0.500 ms\n Execution Time: 8.000 ms\n")
    b = tree.parse(" Index Scan using w_k on w  (cost=0.00..7.00 rows=2 width=9)\n Planning Time: 0.750 ms\n Execution Time: 2.000 ms\n")
    assert diff.unified(a, b, "x", "y") == (
        "--- x\n+++ y\n@@ plan structure @@\n-SEQ_SCAN(w)\n+INDEX_SCAN(w w_k)\n\n"
        " execution time      8.000 ms ->     2.000 ms   (-75.0%)\n planning time       0.500 ms ->     0.750 ms   (+50.0%)\n"
    )
    assert "structure unchanged" in diff.unified(a, a)


def test_reflow_breaks_groups_and_commas():
    text = "   ->  Seq Scan on w  (cost=0.00..72.25 rows=4 width=31) (actual time=0.250..61.500 rows=4 loops=1)\n         Output: aaaaaaaaaaaa, bbbbbbbbbbbbbbb, cccccccccccccccccc"
    out = reflow.reflow(text, 50).split("\n")
    assert out[0] == "   ->  Seq Scan on w" and out[1] == "       (cost=0.00..72.25 rows=4 width=31)"
    assert max(map(len, out)) <= 52 and "".join(out).replace(" ", "") == text.replace("\n", "").replace(" ", "")


DEEP_TEXT = "".join(f"{'  ' * i}{'->  ' if i else ''}Append\n" for i in range(1500))
DEEP_JSON = '[{"Plan": ' + '{"Node Type": "Append", "Plans": [' * 2000 + "]}" * 2000 + "}]"


@pytest.mark.parametrize(
    "text",
    [
        " Seq Scan on t  (cost=1.0.0..2 rows=1 width=1)", " Seq Scan on t  (cost=1.0..2.0 rows=1.2.3 width=1) (actual rows=1.2.3 loops=1)", " Seq Scan on t\n Planning Time: 1.2.3 ms",
        " Seq Scan on t  (cost=1.0..2.0 rows=99999999999999999999 width=1)", " Seq Scan on t  (cost=1.0..2.0 rows=²² width=1)", DEEP_TEXT, DEEP_JSON,
        *('[{"Plan": {"Node Type": "Seq Scan", %s}}]' % x for x in ('"Node Type": 5', '"Strategy": []', '"Plans": 7', '"Plan Rows": 1e400', '"Plan Rows": NaN', '"Plan Rows": 1e25', '"Sort Method": 3', '"Join Type": {}', '"Alias": 4', '"Full-sort Groups": {"Group Count": []}')),
        '[{"Plan": {"Node Type": "Aggregate", "Strategy": ["x"]}}]', '[{"Plan": {"Node Type": "SetOp", "Command": 4}}]', '{"Plan": [1]}', "[[[[", "{",
    ],
)
def test_malformed_captures_never_raise(text):
    row = tables._row(text)
    assert row["error"] is not None or row["nodes"]
    assert all(n["rows_est"] is None or abs(n["rows_est"]) < 1 << 63 for n in row["nodes"])
    for f in (lambda t: jsonplan.to_json(tables.read_any(t)), lambda t: diff.unified(tables.read_any(t), tables.read_any(t))):
        assert isinstance(tables._safely(f, text), str)


def test_tables_survive_bad_captures(spark):
    rows = tables.parse_plans(spark.createDataFrame([(1, None), (2, ""), (3, "[oops"), (4, " Seq Scan on t")], "plan_id bigint, text string"))
    assert {r.plan_id: r.error is None for r in tables.plans(rows).collect()} == {1: False, 2: False, 3: False, 4: True}
    assert tables.plan_nodes(rows).count() == 1


def test_sql_functions(spark):
    tables.register(spark)
    row = spark.sql("select plan_advice(' Seq Scan on t') a, plan_json(' Seq Scan on t') j, reflow_72('x') r, plan_advice(null) n").first()
    assert row.a == "JOIN_ORDER(t)\nSEQ_SCAN(t)\nNO_GATHER(t)\n" and "Seq Scan" in row.j and row.r == "x" and row.n is None
