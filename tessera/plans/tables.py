"""Plans as tables: DataFrames of captured EXPLAIN text -> plans, nodes, properties, advice, diffs.

Parsing is a function of one text, so it is one Arrow-batched function over the text
column and shuffles nothing; its struct result is exploded natively. Comparisons are
joins. Captures that hold no plan get an error, never an exception.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.arrays import chunked, fields_of, lists, struct_type, unrolled
from tessera.shipping import ship

from . import advice as _advice
from . import jsonplan
from .diff import unified
from .props import parse_prop
from .reflow import reflow as _reflow
from .tree import Plan, PlanError, has_plan, parse

NODE = (
    "node_id int, parent_id int, depth int, child_no int, type string, prefixes array<string>, label string, relation string, alias string, index_name string, subplan_name string, "
    "cost_start double, cost_end double, rows_est bigint, rows_actual double, time_actual double, loops bigint, never_executed boolean"
)
PROP = "node_id int, prop_no int, raw string, label string, value string, kind string, fields map<string,string>"
ADVICE = "ord int, kind string, args array<string>, line string, origin string, annotation string"
#: What a capture is read for; a table needs one of these.
PARTS = ("nodes", "props", "advice")


HEAD = "error string, empty boolean, planning_ms double, execution_ms double, extra array<string>"
_COLUMNS = {"nodes": NODE, "props": PROP, "advice": ADVICE}
#: Captures whose rows are held as Python objects at a time.
CHUNK = 500


def parsed_type(parts: tuple[str, ...] = PARTS) -> str:
    return ", ".join([HEAD, *(f"{p} array<struct<{_COLUMNS[p]}>>" for p in PARTS if p in parts)])


PARSED = parsed_type()


#: Trees of the depth of Python's stack; no server makes one.
TOO_DEEP = "nested too deeply"


def read_any(text: str) -> Plan:
    """A plan from text or JSON output, told apart by the first character."""
    return jsonplan.parse_json(text) if text.lstrip()[:1] in ("[", "{") else parse(text)


def _row(text: str | None) -> dict:
    """All that a capture holds, by name."""
    names = [x.split(" ")[0] for x in HEAD.split(", ")]
    out = dict(zip([*names, *PARTS], _read(text, PARTS), strict=True))
    kind = struct_type(PARSED)
    return out | {p: [dict(zip([f.name for f in kind.field(p).type.value_type], x, strict=True)) for x in out[p]] for p in PARTS}


#: Depth from which Python's stack may not do for a plan's decisions.
DEEP = 100


def _read(text: str | None, parts: tuple[str, ...]) -> tuple:
    """HEAD's values, then the rows of each part; those that aren't asked for are left empty."""
    if text is None:
        return "no text", False, None, None, [], (), (), ()
    try:
        plan = read_any(text)
        nodes, props, deepest = _tree_rows(plan, "nodes" in parts, "props" in parts)
        # A plan whose decisions can't be told has no rows in any table.
        decisions = _advice.derive(plan) if "advice" in parts or deepest > DEEP else ()
    except PlanError as e:
        return str(e), False, None, None, [], (), (), ()
    except RecursionError:
        return TOO_DEEP, False, None, None, [], (), (), ()
    rows = ()
    if "advice" in parts:
        found = [("derived", a) for a in decisions] + [("canonical", _advice.canonical(a)) for a in decisions]
        found += [("generated", a) for a in plan.generated] + [("supplied", a) for a in plan.supplied]
        rows = [(i, a.kind, a.args, str(a), o, a.annotation or None) for i, (o, a) in enumerate(found)]
    return None, plan.empty, plan.planning_ms, plan.execution_ms, plan.extra, nodes, props, rows


def _tree_rows(plan: Plan, with_nodes: bool, with_props: bool) -> tuple[list[tuple], list[tuple], int]:
    """(rows of nodes, rows of properties, greatest depth)."""
    nodes: list[tuple] = []
    props: list[tuple] = []
    i = deepest = 0
    todo = [(plan.root, None, 0, 0)] if plan.root is not None else []
    while todo:
        node, parent, depth, child = todo.pop()
        deepest = max(deepest, depth)
        if with_nodes:
            nodes.append((
                i, parent, depth, child, node.type, node.prefixes, node.title, node.relation or None, node.alias or None, node.index or None, node.subplan or None,
                node.cost_start, node.cost_end, node.rows_est, node.rows_actual, node.time_actual, node.loops, node.never,
            ))
        if with_props:
            for k, line in enumerate(node.props):
                p = parse_prop(line)
                props.append((i, k, p.raw, p.label, p.value, p.kind, list(p.fields.items())))
        todo += [(c, i, depth + 1, k) for k, c in reversed(list(enumerate(node.children)))]
        i += 1
    return nodes, props, deepest


def _chunk(texts: list[str | None], parts: tuple[str, ...], kind: pa.StructType) -> pa.StructArray:
    """Column by column; rows of a part hang on their texts by offsets."""
    read = [_read(t, parts) for t in texts]
    arrays = [pa.array([r[i] for r in read], field.type) for i, field in enumerate(kind) if field.name not in PARTS]
    for place, part in enumerate(PARTS):
        if part in parts:
            arrays.append(lists([r[place - len(PARTS)] for r in read], kind.field(part).type))
    return pa.StructArray.from_arrays(arrays, fields=list(kind))


def parsed(text: Column, parts: tuple[str, ...] = PARTS) -> Column:
    """Struct of all that a capture holds, or of some parts of it; see PARSED."""
    ddl = parsed_type(parts)

    @F.arrow_udf(fields_of(ddl))
    def read(texts: pa.Array) -> pa.Array:
        return chunked(texts, CHUNK, lambda some, kind: _chunk(some, parts, kind), ddl)

    return read(text)


def parse_plans(texts: DataFrame, text: str = "text", parts: tuple[str, ...] = PARTS) -> DataFrame:
    """texts plus `parsed`. Parse once, then take the tables below from the result. Where
    only some tables are taken, `parts` names what they need; `plans` needs none."""
    ship(texts.sparkSession)
    return texts.withColumn("parsed", parsed(F.col(text), parts))


def plans(rows: DataFrame, key: str = "plan_id") -> DataFrame:
    return rows.select(key, "parsed.empty", "parsed.planning_ms", "parsed.execution_ms", "parsed.error")


def plan_nodes(rows: DataFrame, key: str = "plan_id") -> DataFrame:
    return unrolled(rows, [key], "parsed.nodes", "node_id")


def plan_props(rows: DataFrame, key: str = "plan_id") -> DataFrame:
    return unrolled(rows, [key], "parsed.props", "prop_no")


def plan_advice(rows: DataFrame, key: str = "plan_id", origin: str | None = "derived") -> DataFrame:
    """Decisions of a plan: derived, canonical, generated or supplied ones (None: all)."""
    out = unrolled(rows, [key], "parsed.advice", "ord")
    return out if origin is None else out.filter(F.col("origin") == origin)


def plan_diff(rows: DataFrame, pairs: DataFrame, canonically: bool = False, key: str = "plan_id") -> DataFrame:
    """(pair_id, ord, kind, before, after) of decisions that differ between the plans of
    a pair (pair_id, before_id, after_id): a full outer join by kind, as one aggregate."""
    lines = plan_advice(rows, key, "canonical" if canonically else "derived").select(F.col(key).alias("id"), "kind", F.struct("line", "ord").alias("x"))
    # Both sides meet their lines in one join, so each capture is parsed once.
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("before_id").alias("id")), F.struct(F.lit(1).alias("side"), F.col("after_id").alias("id")))
    found = pairs.select("pair_id", F.inline(sides)).join(lines, "id")
    # A pair without an id meets none, so its sides stay apart.
    apart = F.when(F.col("pair_id").isNull(), F.col("side")).alias("apart")
    met = found.groupBy("pair_id", "kind", apart).agg(*[F.collect_list(F.when(F.col("side") == i, F.col("x"))).alias(n) for i, n in enumerate(("b", "a"))])
    both = met.select("pair_id", "kind", F.explode_outer("b").alias("b"), "a").select("pair_id", "kind", "b", F.explode_outer("a").alias("a"))
    both = both.select("pair_id", F.coalesce("b.ord", F.col("a.ord") + 1000).alias("ord"), "kind", F.col("b.line").alias("before"), F.col("a.line").alias("after"))
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def same_structure(rows: DataFrame, pairs: DataFrame, canonically: bool = False, key: str = "plan_id") -> DataFrame:
    """(pair_id, same_structure)."""
    changed = plan_diff(rows, pairs, canonically, key).select("pair_id").distinct().withColumn("changed", F.lit(True))
    return pairs.select("pair_id").join(changed, "pair_id", "left").select("pair_id", F.col("changed").isNull().alias("same_structure"))


def has_plan_column(text: Column) -> Column:
    return text.contains("QUERY PLAN") | text.contains("(cost=")


def _safely(f, *texts):
    try:
        return f(*texts)
    except PlanError as e:
        return f"error: {e}"
    except RecursionError:
        return f"error: {TOO_DEEP}"


def functions(spark: SparkSession) -> dict[str, object]:
    """Arrow-batched column functions; all are null for a null text."""
    ship(spark)

    def text_function(f):
        @F.pandas_udf("string")
        def run(t: pd.Series) -> pd.Series:
            return t.map(lambda x: None if x is None else _safely(f, x))

        return run

    def pair_function(f):
        @F.pandas_udf("string")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else _safely(f, x, y) for x, y in zip(a, b, strict=True)], dtype=object)

        return run

    def narrowed(width: int):
        return text_function(lambda t: _reflow(t, width))

    return {
        "plan_json": text_function(lambda t: jsonplan.to_json(read_any(t))),
        "plan_advice": text_function(lambda t: "".join(f"{a}\n" for a in _advice.derive(read_any(t)))),
        "plan_canonical": text_function(lambda t: "".join(f"{a}\n" for a in (map(_advice.canonical, _advice.derive(read_any(t))) if has_plan(t) or not _advice.canonical_text(t) else _advice.canonical_text(t)))),
        "plan_unified_diff": pair_function(lambda a, b: unified(read_any(a), read_any(b))),
        "plan_unified_diff_canonical": pair_function(lambda a, b: unified(read_any(a), read_any(b), canonically=True)),
        "reflow": narrowed,
    }


def register(spark: SparkSession) -> None:
    """The functions for SQL text, under their names; reflow as reflow_72."""
    for name, f in functions(spark).items():
        if name == "reflow":
            spark.udf.register("reflow_72", f(72))
        else:
            spark.udf.register(name, f)
