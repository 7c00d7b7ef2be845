"""Captures and scripts written from the rows of a table, with what is to be read from them.

Each customer row gives one capture and one script by the remainder of its key. A
template has places {k} (the key), {j} (the key after it), {g} (the key's group of ten),
{m} (the key's remainder by seven, plus two). The same template makes Spark's text and
DuckDB's expected rows, so the checks cover as many texts as the table has rows and are
no copy of the parser: what is expected is what was put in.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexer, sql
from tessera.plans import tables, vocab
from tessera.shipping import spread
from tessera.sources import files
from tessera.streaming import text

from .folders import own_folder

GROUP = 10
PLACES = {"k": "c_custkey", "j": "c_custkey + 1", "g": f"c_custkey // {GROUP}", "m": "c_custkey % 7 + 2"}
_PLACE = re.compile(r"\{([kjgm])\}")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("bigint")
    rows = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")).select(k.alias("k"), (k + 1).alias("j"), F.floor(k / GROUP).cast("bigint").alias("g"), (k % 7 + 2).alias("m"))
    return rows.withColumn("t", (F.col("k") % GROUP).cast("int"))


def filled(template: str) -> Column:
    """The template with its places filled from columns."""
    parts = _PLACE.split(template)
    return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def by_remainder(templates: list[str | None]) -> Column:
    case = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, text in enumerate(templates):
        case = case.when(F.col("t") == i, F.lit(None).cast("string") if text is None else filled(text))
    return case


def cell(x) -> str:
    """DuckDB's expression of a cell: a template if it is a string."""
    if x is None:
        return "null"
    if isinstance(x, str):
        parts = _PLACE.split(x)
        quoted = [PLACES[p] if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts)]
        return f"concat({', '.join(quoted)})"
    return f"cast({x!r} as double)" if isinstance(x, float) else str(x).lower()


def expected(columns: str, rows: list[list[tuple]]) -> str:
    """The rows of each remainder as one query; a pair is a template and the type it is cast to."""
    names = columns.split()
    parts = []
    for i, some in enumerate(rows):
        for row in some:
            cells = [f"cast({cell(x[0])} as {x[1]})" if isinstance(x, tuple) else cell(x) for x in row]
            parts.append(f"select {', '.join(f'{c} as {n}' for c, n in zip(['c_custkey', *cells], names, strict=True))} from customer where c_custkey % {GROUP} = {i}")
    return "\nunion all ".join(parts)


# Plans ------------------------------------------------------------------------------------

#: A scan and its index scan, a parallel join without costs, loops with a cache, JSON, no rows, a
#: set operation, advice blocks, blank lines, and a sort over a WITH query.
CAPTURES: list[str | None] = [
    """ Seq Scan on t{g}  (cost=0.00..{k}.50 rows={k} width=15) (actual time=0.010..{m}.125 rows={m} loops=1)
   Filter: (c > {k})
   Rows Removed by Filter: {k}
 Planning Time: 0.25 ms
 Execution Time: {m}.5 ms""",
    """ Index Scan using t{g}_c on t{g}  (cost=0.25..8.50 rows=1 width=15) (actual time=0.020..0.500 rows=1 loops=1)
   Index Cond: (c > {k})
 Planning Time: 0.5 ms
 Execution Time: 0.75 ms""",
    """                         QUERY PLAN
-------------------------------------------------------------
 Gather
   Workers Planned: {m}
   ->  Parallel Hash Left Join
         Hash Cond: (a.u = b.id)
         ->  Parallel Seq Scan on t{g} a
         ->  Parallel Hash
               ->  Parallel Seq Scan on u{k} b
(7 rows)""",
    """ Nested Loop  (cost=0.25..{k}.25 rows=10 width=15) (actual time=0.020..0.125 rows=1.50 loops={m})
   Buffers: shared hit={k} read=1, temp written={m}
   ->  Seq Scan on u{g}  (cost=0.00..30.50 rows=1 width=15) (never executed)
   ->  Memoize  (cost=0.00..30.50 rows=1 width=15)
         Cache Key: u{g}.id
         Hits: {k}  Misses: 2  Evictions: 0  Overflows: 0  Memory Usage: {m}kB
         ->  Index Only Scan using v{g}_pkey on v{g} w  (cost=0.25..8.50 rows=1 width=15)
               Index Cond: (id = u{g}.id)
               Heap Fetches: {m}
 Planning:
   Buffers: shared hit=9
 Planning Time: 0.5 ms
 Execution Time: {k}.125 ms""",
    '[{"Plan": {"Node Type": "Aggregate", "Strategy": "Hashed", "Partial Mode": "Finalize", "Group Key": ["kind"], "Plans": [{"Node Type": "Seq Scan", "Relation Name": "t{g}", "Alias": "c", "Plan Rows": {k}, "Filter": "(a > {m})"}]}, "Execution Time": {m}.5}]',
    "       QUERY PLAN\n------------------------\n(0 rows)\n",
    """ HashSetOp Except All
   ->  Append
         ->  Subquery Scan on "*SELECT* 1"
               ->  Seq Scan on a{g}
         ->  Subquery Scan on "*SELECT* 2"
               ->  Tid Range Scan on b{k}""",
    """ Merge Full Join  (cost=1.00..2.00 rows={k} width=4)
   Merge Cond: (x.id = y.id)
   ->  Sort  (cost=1.00..2.00 rows={k} width=4)
         Sort Key: x.id, x.b DESC
         ->  Seq Scan on x{g} x  (cost=1.00..2.00 rows={k} width=4)
   ->  Materialize  (cost=1.00..2.00 rows=3 width=4)
         ->  Index Scan using y_id on public.y  (cost=1.00..2.00 rows=3 width=4)
 Generated Plan Advice:
   JOIN_ORDER(x y)
   MERGE_JOIN_MATERIALIZE(y)
   SEQ_SCAN(x)
   INDEX_SCAN(y public.y_id)
 Supplied Plan Advice:
   SEQ_SCAN(z{k}) /* not matched */""",
    " \n\n",
    """ Sort  (cost=9.00..10.50 rows={m} width=8) (actual time=1.000..1.500 rows={m} loops=1)
   Sort Key: x.a
   Sort Method: quicksort  Memory: {m}kB
   CTE x
     ->  HashAggregate  (cost=1.00..2.50 rows={m} width=8) (actual time=0.500..0.750 rows={m} loops=1)
           Group Key: t{g}.a, t{g}.b
           Batches: 1  Memory Usage: {m}kB
           ->  Bitmap Heap Scan on t{g}  (cost=1.00..1.50 rows={k} width=8) (actual time=0.125..0.250 rows={k} loops=1)
                 Recheck Cond: (a < {k})
                 Heap Blocks: exact={m}
                 ->  Bitmap Index Scan on t{g}_a  (cost=0.00..0.50 rows={k} width=0) (actual time=0.100..0.125 rows={k} loops=1)
                       Index Cond: (a < {k})
   ->  CTE Scan on x  (cost=0.00..0.50 rows={m} width=8) (actual time=0.500..1.000 rows={m} loops=1)
 Planning Time: 0.125 ms
 Execution Time: 1.75 ms""",
]

_D, _L = "double", "bigint"
#: node_id parent_id depth type prefixes label relation alias index_name subplan_name cost_end rows_est rows_actual never_executed
NODES: list[list[tuple]] = [
    [(0, None, 0, "seq-scan", "", "Seq Scan", "t{g}", None, None, None, ("{k}.50", _D), ("{k}", _L), ("{m}", _D), False)],
    [(0, None, 0, "index-scan", "", "Index Scan", "t{g}", None, "t{g}_c", None, 8.5, 1, 1.0, False)],
    [
        (0, None, 0, "gather", "", "Gather", None, None, None, None, None, None, None, False),
        (1, 0, 1, "hash-join", "Parallel", "Hash Left Join", None, None, None, None, None, None, None, False),
        (2, 1, 2, "seq-scan", "Parallel", "Seq Scan", "t{g}", "a", None, None, None, None, None, False),
        (3, 1, 2, "hash", "Parallel", "Hash", None, None, None, None, None, None, None, False),
        (4, 3, 3, "seq-scan", "Parallel", "Seq Scan", "u{k}", "b", None, None, None, None, None, False),
    ],
    [
        (0, None, 0, "nested-loop", "", "Nested Loop", None, None, None, None, ("{k}.25", _D), 10, 1.5, False),
        (1, 0, 1, "seq-scan", "", "Seq Scan", "u{g}", None, None, None, 30.5, 1, None, True),
        (2, 0, 1, "memoize", "", "Memoize", None, None, None, None, 30.5, 1, None, False),
        (3, 2, 2, "index-only-scan", "", "Index Only Scan", "v{g}", "w", "v{g}_pkey", None, 8.5, 1, None, False),
    ],
    [
        (0, None, 0, "hash-aggregate", "Finalize", "Hash Aggregate", None, None, None, None, None, None, None, False),
        (1, 0, 1, "seq-scan", "", "Seq Scan", "t{g}", "c", None, None, None, ("{k}", _L), None, False),
    ],
    [],
    [
        (0, None, 0, "set-op", "", "HashSetOp Except All", None, None, None, None, None, None, None, False),
        (1, 0, 1, "append", "", "Append", None, None, None, None, None, None, None, False),
        (2, 1, 2, "subquery-scan", "", "Subquery Scan", '"*SELECT* 1"', None, None, None, None, None, None, False),
        (3, 2, 3, "seq-scan", "", "Seq Scan", "a{g}", None, None, None, None, None, None, False),
        (4, 1, 2, "subquery-scan", "", "Subquery Scan", '"*SELECT* 2"', None, None, None, None, None, None, False),
        (5, 4, 3, "tid-range-scan", "", "Tid Range Scan", "b{k}", None, None, None, None, None, None, False),
    ],
    [
        (0, None, 0, "merge-join", "", "Merge Full Join", None, None, None, None, 2.0, ("{k}", _L), None, False),
        (1, 0, 1, "sort", "", "Sort", None, None, None, None, 2.0, ("{k}", _L), None, False),
        (2, 1, 2, "seq-scan", "", "Seq Scan", "x{g}", "x", None, None, 2.0, ("{k}", _L), None, False),
        (3, 0, 1, "materialize", "", "Materialize", None, None, None, None, 2.0, 3, None, False),
        (4, 3, 2, "index-scan", "", "Index Scan", "public.y", None, "y_id", None, 2.0, 3, None, False),
    ],
    [],
    [
        (0, None, 0, "sort", "", "Sort", None, None, None, None, 10.5, ("{m}", _L), ("{m}", _D), False),
        (1, 0, 1, "hash-aggregate", "", "Hash Aggregate", None, None, None, "CTE x", 2.5, ("{m}", _L), ("{m}", _D), False),
        (2, 1, 2, "bitmap-heap-scan", "", "Bitmap Heap Scan", "t{g}", None, None, None, 1.5, ("{k}", _L), ("{k}", _D), False),
        (3, 2, 3, "bitmap-index-scan", "", "Bitmap Index Scan", "t{g}_a", None, None, None, 0.5, ("{k}", _L), ("{k}", _D), False),
        (4, 0, 1, "cte-scan", "", "CTE Scan", "x", None, None, None, 0.5, ("{m}", _L), ("{m}", _D), False),
    ],
]
#: node_id prop_no label kind fields
PROPS: list[list[tuple]] = [
    [(0, 0, "Filter", "expression", "Filter=(c > {k})"), (0, 1, "Rows Removed by Filter", "float", "Rows Removed by Filter={k}")],
    [(0, 0, "Index Cond", "expression", "Index Cond=(c > {k})")],
    [(0, 0, "Workers Planned", "integer", "Workers Planned={m}"), (1, 0, "Hash Cond", "expression", "Hash Cond=(a.u = b.id)")],
    [
        (0, 0, "Buffers", "unknown", "Shared Hit Blocks={k}; Shared Read Blocks=1; Temp Written Blocks={m}"), (2, 0, "Cache Key", "expression", "Cache Key=u{g}.id"),
        (2, 1, "Hits", "unknown", "Cache Evictions=0; Cache Hits={k}; Cache Misses=2; Cache Overflows=0; Peak Memory Usage={m}"),
        (3, 0, "Index Cond", "expression", "Index Cond=(id = u{g}.id)"), (3, 1, "Heap Fetches", "float", "Heap Fetches={m}"),
    ],
    [(0, 0, "Group Key", "list", "Group Key=kind"), (1, 0, "Filter", "expression", "Filter=(a > {m})")],
    [],
    [],
    [(0, 0, "Merge Cond", "expression", "Merge Cond=(x.id = y.id)"), (1, 0, "Sort Key", "list", "Sort Key=x.id, x.b DESC")],
    [],
    [
        (0, 0, "Sort Key", "list", "Sort Key=x.a"), (0, 1, "Sort Method", "text", "Sort Method=quicksort; Sort Space Type=Memory; Sort Space Used={m}"),
        (1, 0, "Group Key", "list", "Group Key=t{g}.a, t{g}.b"), (1, 1, "Batches", "unknown", "HashAgg Batches=1; Peak Memory Usage={m}"),
        (2, 0, "Recheck Cond", "expression", "Recheck Cond=(a < {k})"), (2, 1, "Heap Blocks", "unknown", "Exact Heap Blocks={m}"), (3, 0, "Index Cond", "expression", "Index Cond=(a < {k})"),
    ],
]
#: empty planning_ms execution_ms error
PLANS: list[list[tuple]] = [
    [(False, 0.25, ("{m}.5", _D), None)], [(False, 0.5, 0.75, None)], [(False, None, None, None)], [(False, 0.5, ("{k}.125", _D), None)], [(False, None, ("{m}.5", _D), None)],
    [(True, None, None, None)], [(False, None, None, None)], [(False, None, None, None)], [(False, None, None, "no plan found in the text")], [(False, 0.125, 1.75, None)],
]
#: Decisions: derived, and where they differ canonical; then the blocks of the seventh text.
DERIVED: list[list[str]] = [
    ["JOIN_ORDER(t{g})", "SEQ_SCAN(t{g})", "NO_GATHER(t{g})"],
    ["JOIN_ORDER(t{g})", "INDEX_SCAN(t{g} t{g}_c)", "NO_GATHER(t{g})"],
    ["JOIN_ORDER(a b)", "HASH_JOIN(b)", "SEQ_SCAN(a b)", "GATHER((a b))"],
    ["JOIN_ORDER(u{g} w)", "NESTED_LOOP_MEMOIZE(w)", "SEQ_SCAN(u{g})", "INDEX_ONLY_SCAN(w v{g}_pkey)", "NO_GATHER(u{g} w)"],
    ["JOIN_ORDER(c)", "SEQ_SCAN(c)", "NO_GATHER(c)"],
    [],
    ['JOIN_ORDER("*SELECT* 1" a{g} "*SELECT* 2" b{k})', "SEQ_SCAN(a{g})", 'NO_GATHER("*SELECT* 1" a{g} "*SELECT* 2" b{k})'],
    ["JOIN_ORDER(x public.y)", "MERGE_JOIN_MATERIALIZE(public.y)", "SEQ_SCAN(x)", "INDEX_SCAN(public.y y_id)", "NO_GATHER(x public.y)"],
    [],
    ["JOIN_ORDER(t{g} x)", "BITMAP_HEAP_SCAN(t{g})", "NO_GATHER(t{g} x)"],
]
CANONICAL = list(DERIVED)
CANONICAL[6] = ['JOIN_ORDER("*SELECT* 1" a{g} "*SELECT* 2" b{k})', "SEQ_SCAN(a{g})", 'NO_GATHER("*SELECT* 1" "*SELECT* 2" a{g} b{k})']
CANONICAL[7] = ["JOIN_ORDER(x y)", "MERGE_JOIN_MATERIALIZE(y)", "SEQ_SCAN(x)", "INDEX_SCAN(y y_id)", "NO_GATHER(x y)"]
GIVEN: list[list[tuple]] = [[] for _ in range(GROUP)]
GIVEN[7] = [
    ("generated", "JOIN_ORDER(x y)", None), ("generated", "MERGE_JOIN_MATERIALIZE(y)", None), ("generated", "SEQ_SCAN(x)", None), ("generated", "INDEX_SCAN(y public.y_id)", None),
    ("supplied", "SEQ_SCAN(z{k})", "not matched"),
]


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select(F.col("k").alias("plan_id"), by_remainder(CAPTURES).alias("text"))


def parsed(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    return tables.parse_plans(captures(spark, sf_dir), parts=parts)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each first capture of a group of ten with the second, if the table has it, and each third with itself."""
    k = customers(spark, sf_dir)
    both = k.filter("t = 0").join(k.select(F.col("k").alias("j")), "j").select("k", "j")
    return both.unionByName(k.filter("t = 2").select("k", F.col("k").alias("j"))).toDF("before_id", "after_id").select(F.col("before_id").alias("pair_id"), "before_id", "after_id")


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.plans(parsed(spark, sf_dir))


def plan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.plan_nodes(parsed(spark, sf_dir, "nodes")).withColumn("prefixes", F.array_join("prefixes", " "))
    return rows.select("plan_id", "node_id", "parent_id", "depth", "type", "prefixes", "label", "relation", "alias", "index_name", "subplan_name", "cost_end", "rows_est", "rows_actual", "never_executed")


def plan_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.plan_props(parsed(spark, sf_dir, "props"))
    entries = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows.select("plan_id", "node_id", "prop_no", "label", "kind", F.array_join(entries, "; ").alias("fields"))


def plan_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.plan_advice(parsed(spark, sf_dir, "advice")).select("plan_id", "ord", "kind", "line")


def plan_advice_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.plan_advice(parsed(spark, sf_dir, "advice"), origin="canonical").select("plan_id", "kind", "line")


def plan_advice_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.plan_advice(parsed(spark, sf_dir, "advice"), origin=None)
    return rows.filter(F.col("origin").isin("generated", "supplied")).select("plan_id", "origin", "line", "annotation")


def plan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.plan_diff(parsed(spark, sf_dir, "advice"), pairs(spark, sf_dir)).select("pair_id", "kind", "before", "after")


def plan_same_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.same_structure(parsed(spark, sf_dir, "advice"), pairs(spark, sf_dir))


def plan_unified_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, texts = tables.functions(spark), captures(spark, sf_dir)
    rows = pairs(spark, sf_dir).join(texts.toDF("before_id", "before"), "before_id").join(texts.toDF("after_id", "after"), "after_id")
    return rows.select("pair_id", f["plan_unified_diff"]("before", "after").alias("diff"))


def plan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of each capture, and what parsing that gives again."""
    f = tables.functions(spark)
    rows = captures(spark, sf_dir).select("plan_id", f["plan_json"]("text").alias("json"))
    return rows.select("plan_id", "json", f["plan_advice"]("json").alias("again"))


def plan_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.functions(spark)
    text = F.col("text")
    return captures(spark, sf_dir).select("plan_id", F.when(~text.startswith("["), f["reflow"](60)(text)).alias("narrow"))


def has_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).select("plan_id", tables.has_plan_column(F.col("text")).alias("has_plan"))


def _broken(text: str, *starts: str) -> str:
    """text with the numbers behind each of these line starts on lines of their own, four columns further in."""
    out = []
    for line in text.split("\n"):
        if line.startswith(starts):
            head, *groups = line.split(" (")
            out += [head.rstrip(), *(" " * (len(line) - len(line.lstrip()) + 4) + "(" + g for g in groups)]
        else:
            out.append(line)
    return "\n".join(out)


#: What narrowing to 60 columns gives; only node lines are wider.
NARROW = [
    _broken(CAPTURES[0], " Seq"), _broken(CAPTURES[1], " Index Scan"), CAPTURES[2],
    _broken(CAPTURES[3], " Nested", "   ->  Seq", "         ->  Index"), None, CAPTURES[5], CAPTURES[6],
    _broken(CAPTURES[7], "         ->  "), CAPTURES[8], _broken(CAPTURES[9], " Sort ", "     ->", "           ->", "                 ->", "   ->"),
]

_LEAF = {"Node Type": "Seq Scan"}


def _times(total: str, rows: str, loops: str = "@1@") -> dict:
    return {"Actual Loops": loops, "Actual Rows": rows, "Actual Total Time": total}


def _costs(start: str, total: str, rows: str) -> dict:
    return {"Startup Cost": start, "Total Cost": total, "Plan Rows": rows}


#: JSON of the captures; what stands between @ is no string.
JSON: list = [
    {"Planning Time": "@0.25@", "Execution Time": "@{m}.5@", "Plan": _LEAF | _times("@{m}.125@", "@{m}.0@") | _costs("@0.0@", "@{k}.5@", "@{k}@") | {"Relation Name": "t{g}", "Filter": "(c > {k})", "Rows Removed by Filter": "@{k}.0@"}},
    {"Planning Time": "@0.5@", "Execution Time": "@0.75@", "Plan": {"Node Type": "Index Scan", "Index Name": "t{g}_c", "Relation Name": "t{g}", "Index Cond": "(c > {k})"} | _times("@0.5@", "@1.0@") | _costs("@0.25@", "@8.5@", "@1@")},
    {"Plan": {"Node Type": "Gather", "Workers Planned": "@{m}@", "Plans": [
        {"Node Type": "Hash Join", "Join Type": "Left", "Parallel Aware": "@true@", "Hash Cond": "(a.u = b.id)", "Plans": [
            _LEAF | {"Parallel Aware": "@true@", "Relation Name": "t{g}", "Alias": "a"},
            {"Node Type": "Hash", "Parallel Aware": "@true@", "Plans": [_LEAF | {"Parallel Aware": "@true@", "Relation Name": "u{k}", "Alias": "b"}]}]}]}},
    {"Planning Time": "@0.5@", "Execution Time": "@{k}.125@", "Plan": {"Node Type": "Nested Loop", "Join Type": "Inner", "Shared Hit Blocks": "@{k}@", "Shared Read Blocks": "@1@", "Temp Written Blocks": "@{m}@", "Plans": [
        _LEAF | {"Actual Loops": "@0@", "Relation Name": "u{g}"} | _costs("@0.0@", "@30.5@", "@1@"),
        {"Node Type": "Memoize", "Cache Key": "u{g}.id", "Cache Hits": "@{k}@", "Cache Misses": "@2@", "Cache Evictions": "@0@", "Cache Overflows": "@0@", "Peak Memory Usage": "@{m}@", "Plans": [
            {"Node Type": "Index Only Scan", "Relation Name": "v{g}", "Alias": "w", "Index Name": "v{g}_pkey", "Index Cond": "(id = u{g}.id)", "Heap Fetches": "@{m}.0@"} | _costs("@0.25@", "@8.5@", "@1@")]}
        | _costs("@0.0@", "@30.5@", "@1@")]} | _times("@0.125@", "@1.5@", "@{m}@") | _costs("@0.25@", "@{k}.25@", "@10@")},
    {"Execution Time": "@{m}.5@", "Plan": {"Node Type": "Aggregate", "Strategy": "Hashed", "Partial Mode": "Finalize", "Group Key": ["kind"], "Plans": [_LEAF | {"Relation Name": "t{g}", "Alias": "c", "Plan Rows": "@{k}@", "Filter": "(a > {m})"}]}},
    None,
    {"Plan": {"Node Type": "SetOp", "Strategy": "Hashed", "Command": "Except All", "Plans": [{"Node Type": "Append", "Plans": [
        {"Node Type": "Subquery Scan", "Relation Name": '"*SELECT* 1"', "Plans": [_LEAF | {"Relation Name": "a{g}"}]},
        {"Node Type": "Subquery Scan", "Relation Name": '"*SELECT* 2"', "Plans": [{"Node Type": "Tid Range Scan", "Relation Name": "b{k}"}]}]}]}},
    {"Plan": {"Node Type": "Merge Join", "Join Type": "Full", "Merge Cond": "(x.id = y.id)", "Plans": [
        {"Node Type": "Sort", "Sort Key": ["x.id", "x.b DESC"], "Plans": [_LEAF | {"Relation Name": "x{g}", "Alias": "x"} | _costs("@1.0@", "@2.0@", "@{k}@")]} | _costs("@1.0@", "@2.0@", "@{k}@"),
        {"Node Type": "Materialize", "Plans": [{"Node Type": "Index Scan", "Index Name": "y_id", "Relation Name": "public.y"} | _costs("@1.0@", "@2.0@", "@3@")]} | _costs("@1.0@", "@2.0@", "@3@")]}
        | _costs("@1.0@", "@2.0@", "@{k}@")},
    None,
    {"Planning Time": "@0.125@", "Execution Time": "@1.75@", "Plan": {"Node Type": "Sort", "Sort Key": ["x.a"], "Sort Method": "quicksort", "Sort Space Type": "Memory", "Sort Space Used": "@{m}@", "Plans": [
        {"Node Type": "Aggregate", "Strategy": "Hashed", "Subplan Name": "CTE x", "Group Key": ["t{g}.a", "t{g}.b"], "HashAgg Batches": "@1@", "Peak Memory Usage": "@{m}@", "Plans": [
            {"Node Type": "Bitmap Heap Scan", "Relation Name": "t{g}", "Recheck Cond": "(a < {k})", "Exact Heap Blocks": "@{m}@", "Plans": [
                {"Node Type": "Bitmap Index Scan", "Relation Name": "t{g}_a", "Index Cond": "(a < {k})"} | _costs("@0.0@", "@0.5@", "@{k}@") | _times("@0.125@", "@{k}.0@")]}
            | _costs("@1.0@", "@1.5@", "@{k}@") | _times("@0.25@", "@{k}.0@")]} | _costs("@1.0@", "@2.5@", "@{m}@") | _times("@0.75@", "@{m}.0@"),
        {"Node Type": "CTE Scan", "Relation Name": "x"} | _costs("@0.0@", "@0.5@", "@{m}@") | _times("@1.0@", "@{m}.0@")]}
        | _costs("@9.0@", "@10.5@", "@{m}@") | _times("@1.5@", "@{m}.0@")},
]


def _json_text(x) -> str:
    return json.dumps([x], indent=2, sort_keys=True).replace('"@', "").replace('@"', "")


_KIND_OF = re.compile(r"^[A-Z_]+")
_JSON_ROWS = [[(("{k}", _L), _json_text(x), "".join(f"{a}\n" for a in DERIVED[i]))] if x else [] for i, x in enumerate(JSON)]
_JSON_ROWS[5] = [(("{k}", _L), "[]", "error: no Plan object")]
_JSON_ROWS[8] = [(("{k}", _L), "error: no plan found in the text", "")]


def _advice_rows(lines: list[list[str]], numbered: bool) -> list[list[tuple]]:
    return [[((i,) if numbered else ()) + (_KIND_OF.match(x)[0], x) for i, x in enumerate(some)] for some in lines]


_CHANGED = "from customer a join customer b on b.c_custkey = a.c_custkey + 1 where a.c_custkey % 10 = 0"
_EXECUTION = "(a.c_custkey % 7 + 2.5)"
PLAN_ORACLES = {
    "plans": expected("plan_id empty planning_ms execution_ms error", PLANS),
    "plan_nodes": expected("plan_id node_id parent_id depth type prefixes label relation alias index_name subplan_name cost_end rows_est rows_actual never_executed", NODES),
    "plan_props": expected("plan_id node_id prop_no label kind fields", PROPS),
    "plan_advice": expected("plan_id ord kind line", _advice_rows(DERIVED, True)),
    "plan_advice_canonical": expected("plan_id kind line", _advice_rows(CANONICAL, False)),
    "plan_advice_blocks": expected("plan_id origin line annotation", GIVEN),
    "plan_json": expected("plan_id json again", [[row[1:] for row in some] for some in _JSON_ROWS]),
    "plan_reflow": expected("plan_id narrow", [[(x,)] for x in NARROW]),
    "has_plan": expected("plan_id has_plan", [[(i not in (4, 6, 8),)] for i in range(GROUP)]),
    "plan_diff": f"""
select a.c_custkey as pair_id, 'SEQ_SCAN' as kind, concat('SEQ_SCAN(t', a.c_custkey // 10, ')') as before, null as after {_CHANGED}
union all select a.c_custkey, 'INDEX_SCAN', null, concat('INDEX_SCAN(t', a.c_custkey // 10, ' t', a.c_custkey // 10, '_c)') {_CHANGED}""",
    "plan_same_structure": f"select a.c_custkey as pair_id, false as same_structure {_CHANGED} union all select c_custkey, true from customer where c_custkey % 10 = 2",
    "plan_unified_diff": f"""
select a.c_custkey as pair_id, concat('--- before', chr(10), '+++ after', chr(10), '@@ plan structure @@', chr(10), '-SEQ_SCAN(t', a.c_custkey // 10, ')', chr(10), '+INDEX_SCAN(t', a.c_custkey // 10, ' t', a.c_custkey // 10, '_c)', chr(10), chr(10),
  printf(' execution time  %9.3f ms -> %9.3f ms   (%+.1f%%)', {_EXECUTION}, 0.75, (0.75 - {_EXECUTION}) / {_EXECUTION} * 100), chr(10), ' planning time       0.250 ms ->     0.500 ms   (+100.0%)', chr(10)) as diff {_CHANGED}
union all select c_custkey, concat('--- before', chr(10), '+++ after', chr(10), '@@ plan structure @@', chr(10), ' structure unchanged - the planner made the same decisions', chr(10)) from customer where c_custkey % 10 = 2""",
}


#: Every spelling of a node, a row each in turn; each third one runs in parallel.
SPELLINGS = sorted({x for spellings in vocab.NODE_SPELLINGS.values() for x in spellings} | {f"{j} {how} Join" for j in ("Hash", "Merge", "Nested Loop") for how in vocab.JOIN_VARIANTS} | {"SetOp Intersect All", "HashSetOp Except", "Frobnicate"})


def plan_node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.from_json(F.lit(json.dumps(SPELLINGS)), "array<string>")
    spelled = F.get(names, (F.col("k") % len(SPELLINGS)).cast("int"))
    line = F.concat(F.lit(" "), F.when(F.col("k") % 3 == 0, "Parallel ").otherwise(""), spelled, F.when(F.col("k") % 2 == 0, filled(" on t{k}")).otherwise(""), filled("  (cost=0.00..{k}.50 rows={m} width=4)"))
    rows = tables.parse_plans(customers(spark, sf_dir).select(F.col("k").alias("plan_id"), line.alias("text")), parts=("nodes",))
    return tables.plan_nodes(rows).select("plan_id", "type", F.array_join("prefixes", " ").alias("prefixes"), "relation", "cost_end", "rows_est")


#: Types follow from spellings: words parted by -, in lower case; what else there is stands in the CASE.
PLAN_ORACLES["plan_node_types"] = f"""
with s as (select c_custkey as k, [{', '.join(f"'{x}'" for x in SPELLINGS)}][c_custkey % {len(SPELLINGS)} + 1] as s from customer)
select k as plan_id, case when s = 'Frobnicate' then 'unknown' when s = 'Material' then 'materialize' when s = 'WorkTable Scan' then 'worktable-scan' when s like '%SetOp%' or s = 'Set Op' then 'set-op'
         when s like 'Hash % Join' then 'hash-join' when s like 'Merge % Join' then 'merge-join' when s like 'Nested Loop%' then 'nested-loop'
         else lower(replace(regexp_replace(regexp_replace(s, ' Backward$', ''), '([a-z])([A-Z])', '\\1-\\2', 'g'), ' ', '-')) end as type,
       case when k % 3 = 0 then 'Parallel' else '' end as prefixes, case when k % 2 = 0 and s <> 'Frobnicate' then 't' || k end as relation,
       cast(k || '.50' as double) as cost_end, cast(k % 7 + 2 as bigint) as rows_est
  from s"""


# Scripts -----------------------------------------------------------------------------------

#: Tokens as they are to be read: (kind, text).
POOL: list[tuple[str, str]] = [
    ("keyword", "SELECT"), ("ident", "abc"), ("ident", '"Q""x"'), ("string", "'it''s'"), ("string", "E'a\\'b'"), ("string", "B'01'"), ("string", "U&'d'"), ("string", "''"),
    ("dollar_string", "$$a;b$$"), ("dollar_string", "$t$ $$ $t$"), ("param", "$1"), ("param", ":name"), ("param", ":'name'"), ("number", "1.5e3"), ("number", "1_000"), ("number", "7"),
    ("ident", "naïve"), ("keyword", "from"), ("punct", ","), ("punct", "["), ("punct", "]"), ("punct", "."), ("ident", "x$1"), ("keyword", "Lateral"), ("ident", "_u"), ("string", "X'1f'"),
    *(("operator", o) for o in sorted(lexer.OPERATORS)), *(("operator", o) for o in "+-*/<>=~!@#%^&|`?"),
]
#: Tokens of a script, before its key is added to them.
LEAST_TOKENS = 12


def _place(k: str, i: str) -> str:
    """Number of the token at a place, in SQL that both engines read."""
    return f"(({k}) * 7 + ({i}) * ({i}) * 3 + ({i})) % {len(POOL)}"


def token_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): tokens of the pool, with a semicolon at each eleventh place; between them
    spaces, block comments with one inside, comments of a line, and blank lines. Each fourth
    script starts with a client command."""
    words = F.from_json(F.lit(json.dumps([t for _, t in POOL], ensure_ascii=False)), "array<string>")
    n = F.col("k") % 18 + LEAST_TOKENS

    def one(i: Column) -> Column:
        gap = F.when(i % 13 == 5, "\n\n").when(i % 5 == 2, " /* a /* b */ c */ ").when(i % 7 == 3, "\n-- note\n").otherwise(" ")
        at = (F.col("k") * 7 + i * i * 3 + i) % len(POOL)
        return F.concat(F.when(i % 11 == 10, ";").otherwise(F.get(words, at.cast("int"))), gap)

    body = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), one), "")
    return customers(spark, sf_dir).select(F.col("k").alias("path"), F.concat(F.when(F.col("k") % 4 == 0, "\\echo hello\n").otherwise(""), body).alias("text"))


def sql_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql.sql_tokens(token_scripts(spark, sf_dir))
    return rows.select("path", "stmt_no", "kind", "text", "line", "leading_blank", F.array_join("comments", "|").alias("comments"), "trailing_comment").filter("stmt_no >= 0")


def statement_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql.statement_rows(token_scripts(spark, sf_dir)).select("path", "stmt_no", "n_tokens", F.col("kind").isin("psql").alias("psql"))


_POOL_ROWS = ", ".join(f"({i}, '{kind}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (kind, text) in enumerate(POOL))
_TOKEN_ROWS = f"""
pool(n, kind, text) as (values {_POOL_ROWS}),
place as (select c_custkey as path, i from customer, lateral (select unnest(range(c_custkey % 18 + {LEAST_TOKENS})) as i)),
token as (
  select path, i, i % 11 = 10 as ends, {_place('path', 'i')} as n,
         count(*) filter (where i % 11 = 10) over (partition by path order by i rows between unbounded preceding and 1 preceding) + (path % 4 = 0)::int as stmt_no,
         1 + (path % 4 = 0)::int + coalesce(2 * count(*) filter (where i % 13 = 5 or i % 5 <> 2 and i % 7 = 3) over (partition by path order by i rows between unbounded preceding and 1 preceding), 0) as line
    from place)"""
SCRIPT_ORACLES = {
    "sql_tokens": f"""with {_TOKEN_ROWS}
select path, stmt_no, kind, text, line, i > 0 and (i - 1) % 13 = 5 as leading_blank,
       case when i > 0 and (i - 1) % 7 = 3 and (i - 1) % 13 <> 5 and (i - 1) % 5 <> 2 then '-- note' else '' end as comments,
       case when i % 5 = 2 and i % 13 <> 5 then '/* a /* b */ c */' end as trailing_comment
  from token join pool using (n) where not ends
union all select c_custkey, 0, 'backslash_cmd', '\\echo hello', 1, false, '', null from customer where c_custkey % 4 = 0""",
    "statement_kinds": f"""with {_TOKEN_ROWS}
select path, stmt_no, count(*) as n_tokens, false as psql from token where not ends group by path, stmt_no
union all select c_custkey, 0, 1, true from customer where c_custkey % 4 = 0""",
}


#: Scripts as they are typed, and as they are laid out.
SCRIPTS: list[str | None] = [
    """SELECT a{k}, count(*) FILTER (WHERE b > {m}) AS n, rank() over (partition by a order by b) r FROM t{g} LEFT OUTER JOIN u USING(id) JOIN lateral (select x from v where v.id = t{g}.id and v.name like 'a text that is long enough to break the line' order by x limit 3) w on true WHERE x BETWEEN 1 AND {k} AND (y or z) GROUP BY a ORDER BY n DESC nulls last LIMIT 9;
select case kind when {m} then 'one' else 'a text that is long enough to break this expression {k}' end as kind, x from t where exists (select 1 from u where u.id = t.id and u.value > {k} and u.other_value < {m} and u.name = 'abcdefgh') ;""",
    """CREATE TABLE t{g} (id serial primary key, name text not null default 'x', val numeric(10,2) check (val > {m}), unique (name), foreign key (val) references u(id) on delete cascade);
create unique index concurrently t{g}_idx on t{g} (name, id) where val > {k} and name is not null and id is not null;
create or replace view v{k} as select id, name from t{g} where val > {m};""",
    """with recursive x(n, total) as (select 1, {m} union all select n + 1, total * {m} from x where n < {k}) search depth first by n set ord cycle n set is_cycle using path select * from x union select n, total from y except all select 1, 2;
insert into t{g}(id, name) values ({k}, 'a'), ({m}, 'b') on conflict (id) do update set name = excluded.name where t{g}.id > {m} returning id;
delete from t{g} using u where u.id = t{g}.id and u.a_rather_long_column_name = {k} and u.another_long_column_name = {m} returning *;""",
    """merge into t{g} using s on t{g}.id = s.id when matched and s.v > {k} then update set v = s.v when matched then delete when not matched then insert (id, v) values (s.id, {m}) ;
grant select, insert on table t{g} to role_a, role_b with grant option; revoke all privileges on all tables in schema public from x{k} cascade;
alter table t{g} add column c{k} int not null default {m}, drop column d cascade, alter column e type text using e::text;""",
    """create function f{g}(a int, b text default 'x') returns int as $$ select a + {k} from t where t.a = a $$ language sql immutable strict;
create function g{g}() returns trigger language plpgsql as $$ begin if new.a > {k} then raise notice 'a message that is long enough for the author to have wide lines'; else perform f(); end if; for r in select 1 loop null; end loop; return new; exception when others then return null; end; $$;
create trigger tr after insert or update on t{g} for each row execute function g{g}();""",
    """prepare p{g} (int, text) as select * from t where a = $1 and b = $2; execute p{g}({k}, 'x'); deallocate p{g};
explain (analyze, buffers) select a, b from t{g} where a > {k};
begin; commit; set search_path to a, b;""",
    """select a, sum(b) over w, max(c) from t{g} window w as (partition by d order by e) order by 1 for update;
-- a note on this one, which is long enough to be wrapped because it has more than eighty characters in all, number {k}
select a, -- first
b -- second one
from t; values (1, 'a'), ({k}, 'b'); table t{g}; truncate t{g}, u;""",
    """select * from graph_table (g match (a is person where a.id = {k})-[e is knows]->(b is person) columns (a.name as n, b.name as m, a.age as a_rather_long_name));
create property graph pg{g} vertex tables (a key (id) label person properties (id, name), b) edge tables (e key (a_id, b_id) source key (a_id) references a (id) destination key (b_id) references b (id) label knows);""",
    """select coalesce(first_long_column_name, second_long_column_name, third_long_column_name, {k}) as value, x || ' and a long text' || y || ' and another long text {k}' || z as concatenated from t;
select a in (select b from c where c.d = t.d and c.e_is_a_long_name > {k} and c.f_is_a_long_name < {m}) as found from t;""",
    r"""\set x {k}
select a, b from t{g} group by grouping sets ((a, b), (a), ()) having count(*) > :x and bool_and(b);
create table p{g} partition of t for values from ({m}) to ({k}); comment on table t{g} is 'x';""",
]
LAID_OUT = [
    """           select a{k},
                  count(*) filter(where b > {m}) as n,
                  rank() over(partition by a order by b) r
             from t{g}
  left outer join u using(id)
     join lateral (
         select x
           from v
          where v.id = t{g}.id
            and v.name like 'a text that is long enough to break the line'
       order by x
          limit 3
     ) w
               on true
            where x between 1 and {k}
              and (y or z)
         group by a
         order by n desc nulls last
            limit 9;

select case kind
            when {m}
            then 'one'
            else 'a text that is long enough to break this expression {k}'
       end as kind,
       x
  from t
 where exists
       (
         select 1
           from u
          where u.id = t.id
            and u.value > {k}
            and u.other_value < {m}
            and u.name = 'abcdefgh'
       );
""",
    """create table t{g}
 (
  id   serial primary key,
  name text not null default 'x',
  val  numeric(10, 2) check (val > {m}),

  unique (name),
  foreign key (val) references u(id) on delete cascade
);

create unique index concurrently t{g}_idx
   on t{g}(name, id)
where val > {k} and name is not null and id is not null;

create or replace view v{k} as
  select id, name
    from t{g}
   where val > {m};
""",
    """with recursive x(n, total) as (
  select 1, {m}
  union all
  select n + 1, total * {m}
    from x
   where n < {k}
) search depth first by n set ord cycle n set is_cycle using path
select * from x
union
select n, total
  from y
except all
select 1, 2;

insert into t{g}(id, name)
     values ({k}, 'a'), ({m}, 'b')
on conflict (id) do
     update
        set name = excluded.name
      where t{g}.id > {m}
  returning id;

   delete
     from t{g}
    using u
    where u.id = t{g}.id
      and u.a_rather_long_column_name = {k}
      and u.another_long_column_name = {m}
returning *;
""",
    """merge into t{g}
using s
   on t{g}.id = s.id
when matched and s.v > {k} then
  update set v = s.v
when matched then
  delete
when not matched then
  insert (id, v)
  values (s.id, {m});

grant select, insert on table t{g} to role_a, role_b with grant option;

revoke all privileges on all tables in schema public from x{k} cascade;

alter table t{g}
  add column c{k} int not null default {m},
  drop column d cascade,
  alter column e type text using e::text;
""",
    """create function f{g}(a int, b text default 'x')
  returns int
 language sql
       as $$
  select a + {k} from t where t.a = a
$$
immutable
   strict;

create function g{g}()
 returns trigger
language plpgsql
      as $$
begin
  if new.a > {k} then
    raise notice 'a message that is long enough for the author to have wide lines';
  else
    perform f();
  end if;
  for r in select 1 loop
    null;
  end loop;
  return new;
exception
  when others then
    return null;
end;
$$;

create trigger tr
  after insert or update
     on t{g}
    for each row
execute function g{g}();
""",
    """prepare p{g}(int, text) as
 select * from t where a = $1 and b = $2;

execute p{g}({k}, 'x');

deallocate p{g};

explain (analyze, buffers)
 select a, b
   from t{g}
  where a > {k};

begin;

commit;

set search_path to a, b;
""",
    """  select a, sum(b) over w, max(c)
    from t{g}
  window w as (partition by d order by e)
order by 1
     for update;

-- a note on this one, which is long enough to be wrapped because it has more
-- than eighty characters in all, number {k}
select a,  -- first
       b   -- second one
  from t;

values (1, 'a'), ({k}, 'b');

table t{g};

truncate t{g}, u;
""",
    """select *
  from graph_table (
                     g
                     match (a is person where a.id = {k})-[e is knows]->(b is person)
                     columns (a.name as n, b.name as m, a.age as a_rather_long_name)
                   );

create property graph pg{g}
  vertex tables (a key (id) label person properties (id, name), b)
  edge tables (
    e key (a_id, b_id)
      source key (a_id) references a(id)
      destination key (b_id) references b(id)
      label knows
  );
""",
    """select coalesce(
         first_long_column_name, second_long_column_name,
         third_long_column_name, {k}
       ) as value,
       x
    || ' and a long text'
    || y
    || ' and another long text {k}'
    || z as concatenated
  from t;

select a in
         (
           select b
             from c
            where c.d = t.d
              and c.e_is_a_long_name > {k}
              and c.f_is_a_long_name < {m}
         ) as found
  from t;
""",
    r"""\set x {k}

  select a, b
    from t{g}
group by grouping sets ((a, b), (a), ())
  having count(*) > :x
     and bool_and(b);

create table p{g} partition of t for values from ({m}) to ({k});

comment on table t{g} is 'x';
""",
]
#: Kinds of the scripts' statements.
KINDS: list[list[str]] = [
    ["query", "query"], ["create table", "create index", "create view"], ["query", "insert", "delete"], ["merge", "grant", "revoke", "alter table"],
    ["create function", "create function", "create trigger"], ["prepare", "execute", "deallocate", "explain", "begin", "commit", "set"], ["query", "query", "query", "query", "truncate"],
    ["query", "create property"], ["query", "query"], ["psql", "query", "create table", "comment"],
]


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select(F.col("k").alias("path"), by_remainder(SCRIPTS).alias("text"))


def format_sql_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts laid out; what is laid out already stays as it is."""
    rows = sql.format_corpus(scripts(spark, sf_dir)).select("path", "output", "error", "changed")
    return rows.select("*", (sql.format_column(F.col("output"))["output"] == F.col("output")).alias("stable"))


def format_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts as a stream of files, laid out by a streaming query that takes what is there."""
    folder = own_folder(spark)
    rows = scripts(spark, sf_dir)
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    text.to_folder(text.format_stream(stream), f"{folder}/out", f"{folder}/state").start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("path", "output", "error", "changed")


def plan_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures as a stream, and the nodes of each."""
    folder = own_folder(spark)
    rows = captures(spark, sf_dir)
    rows.write.parquet(f"{folder}/in")
    stream = tables.plan_nodes(text.plan_stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")))
    text.to_folder(stream.select("plan_id", "node_id", "type", "relation"), f"{folder}/out", f"{folder}/state").start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def files_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred scripts a file, read back whole, split into statements again."""
    folder = own_folder(spark)
    rows = scripts(spark, sf_dir).filter(F.col("text").isNotNull()).groupBy(F.floor(F.col("path") / 100).alias("file"))
    rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "\n").alias("text")).write.partitionBy("file").text(f"{folder}/scripts")
    found = files.read_sql_files(spark, f"{folder}/scripts", "*.txt")
    return sql.statement_rows(found).groupBy("kind").agg(F.count("*").alias("n"))


def format_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that can't be read have an error with its line, and no output."""
    broken = ["select\n'open {k}", 'select "open {k}', "select 1 /* open /* {k} */", "select\n\n$a$ open {k} $b$", None, "", "select 'it''s {k}'", "-- only a note {k}", ";", "select E'\\\\' || '{k}'"]
    rows = customers(spark, sf_dir).select(F.col("k").alias("path"), by_remainder(broken).alias("text"))
    return sql.format_corpus(rows).select("path", "output", "error", F.col("changed").cast("string").alias("changed"))


def script_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql.statement_rows(scripts(spark, sf_dir)).select("path", "stmt_no", "kind", "n_comments")


def statements_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements inside the JVM, of the scripts without dollar quotes."""
    rows = sql.native_token_rows(scripts(spark, sf_dir).filter(~F.col("text").contains("$$")))
    return rows.groupBy("path", "stmt_no").agg(F.count("*").alias("n_tokens"), F.max("depth").cast("bigint").alias("depth"))


def split_dollar_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["$$body {k}$$", "$tag$body {k}$tag$", "$a$ $b$ {k} $b$ $a$", "$$open {k}", "'no {k}'", None, "$$$$", "$a$x{k}$b$", "$$a$$b{k}$$", "$x1$\n{k}\n$x1$"]
    rows = customers(spark, sf_dir).select(F.col("k").alias("path"), by_remainder(forms).alias("text"))
    return rows.withColumn("x", sql.split_dollar_quoted(F.col("text"))).select("path", "x.delimiter", "x.body")


def unified_diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir).select(F.col("k").alias("path"), filled("select {k};\nsame\n").alias("a"), F.when(F.col("t") < 5, filled("select {k};\nsame\n")).otherwise(filled("select {j};\nsame\n")).alias("b"))
    return rows.select("path", sql.unified_diff(F.col("a"), F.col("b")).alias("diff"))


_NOTES = {(6, 1): 3}  # a note before the second statement of the seventh script, and two behind its lines
_RX = lexer.NATIVE_TOKEN.replace("'", "''")
_SCRIPT_TEXT = "case c_custkey % 10 " + " ".join(f"when {i} then {cell(x)}" for i, x in enumerate(SCRIPTS)) + " end"
SCRIPT_ORACLES |= {
    "format_sql_corpus": expected("path output error changed stable", [[(x, None, True, True)] for x in LAID_OUT]),
    "format_streamed": expected("path output error changed", [[(x, None, True)] for x in LAID_OUT]),
    "format_errors": expected("path output error changed", [
        [(None, "unterminated string literal at line 2", None)], [(None, "unterminated quoted identifier at line 1", None)], [(None, "unterminated block comment at line 1", None)],
        [(None, "unterminated dollar-quoted string at line 3", None)], [(None, None, None)], [("", None, "false")], [("select 'it''s {k}'\n", None, "true")], [("-- only a note {k}\n", None, "true")],
        [("", None, "true")], [("select E'\\\\' || '{k}'\n", None, "true")]]),
    "script_statements": expected("path stmt_no kind n_comments", [[(n, kind, _NOTES.get((i, n), 0)) for n, kind in enumerate(some)] for i, some in enumerate(KINDS)]),
    "statements_native": f"""
with s as (select c_custkey as path, {_SCRIPT_TEXT} as text from customer),
t as (select path, unnest(regexp_extract_all(text, '{_RX}')) as t, unnest(range(len(regexp_extract_all(text, '{_RX}')))) as i from s where not contains(text, '$$')),
d as (select *, sum(case t when '(' then 1 when ')' then -1 else 0 end) over (partition by path order by i) as depth from t),
n as (select *, coalesce(sum(case when t = ';' and depth <= 0 then 1 else 0 end) over (partition by path order by i rows between unbounded preceding and 1 preceding), 0) as stmt_no from d)
select path, cast(stmt_no as int) as stmt_no, count(*) as n_tokens, cast(max(depth) as bigint) as depth from n group by path, stmt_no""",
    "split_dollar_quoted": expected("path delimiter body", [
        [("$$", "body {k}")], [("$tag$", "body {k}")], [("$a$", " $b$ {k} $b$ ")], [(None, None)], [(None, None)], [(None, None)], [("$$", "")], [(None, None)], [(None, None)], [("$x1$", "\n{k}\n")]]),
    "unified_diff_text": expected("path diff", [[("",)]] * 5 + [[("--- before\n+++ after\n@@ -1,3 +1,3 @@\n-select {k};\n+select {j};\n same\n ",)]] * 5),
}

QUERIES = {
    f.__name__: f
    for f in (
        plans, plan_nodes, plan_props, plan_advice, plan_advice_canonical, plan_advice_blocks, plan_diff, plan_same_structure, plan_unified_diff, plan_json, plan_reflow, has_plan, plan_node_types,
        sql_tokens, statement_kinds, script_statements, statements_native, format_sql_corpus, format_streamed, plan_streamed, files_on_disk, format_errors, split_dollar_quoted, unified_diff_text,
    )
}
SCRIPT_ORACLES["plan_streamed"] = expected("plan_id node_id type relation", [[(n[0], n[3], n[6]) for n in some] for some in NODES])
SCRIPT_ORACLES["files_on_disk"] = f"select kind, count(*) as n from ({SCRIPT_ORACLES['script_statements']}) group by kind"
ORACLES = PLAN_ORACLES | SCRIPT_ORACLES
