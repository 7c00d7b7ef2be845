"""Fixed values of PostgreSQL's EXPLAIN vocabulary, as plain tables."""

from __future__ import annotations

#: Node type -> spellings in plan text; the first one is its display label.
NODE_SPELLINGS = {
    "index-only-scan": ("Index Only Scan", "Index Only Scan Backward"),
    "index-scan": ("Index Scan", "Index Scan Backward"),
    "bitmap-heap-scan": ("Bitmap Heap Scan",),
    "bitmap-index-scan": ("Bitmap Index Scan",),
    "bitmap-and": ("BitmapAnd", "Bitmap And"),
    "bitmap-or": ("BitmapOr", "Bitmap Or"),
    "tid-range-scan": ("Tid Range Scan",),
    "tid-scan": ("Tid Scan",),
    "sample-scan": ("Sample Scan",),
    "function-scan": ("Function Scan",),
    "table-function-scan": ("Table Function Scan",),
    "values-scan": ("Values Scan",),
    "foreign-scan": ("Foreign Scan",),
    "subquery-scan": ("Subquery Scan",),
    "cte-scan": ("CTE Scan",),
    "worktable-scan": ("WorkTable Scan",),
    "named-tuplestore-scan": ("Named Tuplestore Scan",),
    "custom-scan": ("Custom Scan",),
    "seq-scan": ("Seq Scan",),
    "hash-aggregate": ("Hash Aggregate", "HashAggregate"),
    "group-aggregate": ("Group Aggregate", "GroupAggregate"),
    "mixed-aggregate": ("Mixed Aggregate", "MixedAggregate"),
    "aggregate": ("Aggregate",),
    "window-agg": ("Window Agg", "WindowAgg"),
    "group": ("Group",),
    "incremental-sort": ("Incremental Sort",),
    "sort": ("Sort",),
    "unique": ("Unique",),
    "merge-append": ("Merge Append",),
    "append": ("Append",),
    "materialize": ("Materialize", "Material"),
    "memoize": ("Memoize",),
    "limit": ("Limit",),
    "lock-rows": ("Lock Rows", "LockRows"),
    "set-op": ("Set Op", "SetOp", "HashSetOp"),
    "result": ("Result",),
    "gather-merge": ("Gather Merge", "GatherMerge"),
    "gather": ("Gather",),
    "recursive-union": ("Recursive Union",),
    "project-set": ("Project Set", "ProjectSet"),
    "modify-table": ("ModifyTable",),
    "update": ("Update",),
    "insert": ("Insert",),
    "delete": ("Delete",),
    "hash": ("Hash",),
    "hash-join": ("Hash Join",),
    "nested-loop": ("Nested Loop",),
    "merge-join": ("Merge Join",),
}
UNKNOWN_LABEL = "Node"

PREFIXES = ("Parallel", "Partial", "Finalize")
JOIN_VARIANTS = ("Left", "Right", "Full", "Semi", "Anti")
SET_COMMANDS = ("Intersect All", "Intersect", "Except All", "Except")
JOINS = ("hash-join", "nested-loop", "merge-join")

#: Property labels by kind, and units.
PROPERTY_KINDS = {
    "expression": (
        "Filter", "Index Cond", "Recheck Cond", "Hash Cond", "Merge Cond", "TID Cond", "Join Filter", "One-Time Filter", "Conflict Filter",
        "Order By", "Run Condition", "Cache Key", "Hash Keys", "Function Call", "Table Function Call", "Index Recheck", "Filter Removed by Join Filter",
    ),
    "list": ("Output", "Sort Key", "Group Key", "Presorted Key", "Hash Key", "Grouping Sets", "Group Keys", "Sort Methods Used", "Conflict Arbiter Indexes", "Sampling Parameters"),
    "float": (
        "Rows Removed by Filter", "Rows Removed by Join Filter", "Rows Removed by Index Recheck", "Rows Removed by Conflict Filter", "Heap Fetches",
        "Conflicting Tuples", "Tuples Inserted", "Tuples Updated", "Tuples Deleted", "Tuples Skipped", "I/O Read Time", "I/O Write Time", "Subplan Duration",
    ),
    "integer": (
        "Workers Planned", "Workers Launched", "Worker Number", "Subplans Removed", "Index Searches", "Query Identifier", "Exact Heap Blocks", "Lossy Heap Blocks",
        "Planned Partitions", "Group Count", "Sort Space Used", "Peak Memory Usage", "Memory Used", "Memory Allocated", "Maximum Storage", "Disk Usage",
        "Average Sort Space Used", "Peak Sort Space Used", "Task Count", "Map Task Count", "Merge Task Count", "Intermediate Data Size",
        "Tuple data received from nodes", "Tuple data received from node",
    ),
    "text": (
        "Sort Method", "Sort Space Type", "Storage", "Cache Mode", "Scan Direction", "Index Name", "Relation Name", "Alias", "Schema", "Join Type", "Partial Mode",
        "Parent Relationship", "Subplan Name", "Command", "Strategy", "Operation", "Node Type", "Settings", "Sampling Method", "Repeatable Seed",
        "Custom Plan Provider", "Constraint Name", "Trigger Name", "CTE Name", "Function Name", "Table Function Name", "Tuplestore Name", "Window",
        "Tasks Shown", "Node", "Query", "Error", "Result destination", "INSERT/SELECT method", "MERGE INTO ... method",
    ),
    "bool": ("Parallel Aware", "Async Capable", "Inner Unique", "Single Copy", "Disabled", "Inlining", "Optimization", "Expressions", "Deforming"),
}
UNITS = {
    "kB": ("Sort Space Used", "Peak Memory Usage", "Memory Used", "Memory Allocated", "Maximum Storage", "Disk Usage", "Average Sort Space Used", "Peak Sort Space Used"),
    "ms": ("Subplan Duration",),
    "bytes": ("Intermediate Data Size", "Tuple data received from nodes", "Tuple data received from node"),
}
KIND_OF = {label: kind for kind, labels in PROPERTY_KINDS.items() for label in labels}
UNIT_OF = {label: unit for unit, labels in UNITS.items() for label in labels}

#: Lines that the server assembles of several counters. "first": key of the value
#: before any label; "labels": key of each "Label: value"; "pairs": key of each name=value.
COMPOSITES = {
    "Buckets": {"first": "Hash Buckets", "labels": {"Batches": "Hash Batches", "Memory Usage": "Peak Memory Usage"}},
    "Batches": {"first": "HashAgg Batches", "labels": {"Memory Usage": "Peak Memory Usage", "Disk Usage": "Disk Usage"}},
    "Hits": {"first": "Cache Hits", "labels": {"Misses": "Cache Misses", "Evictions": "Cache Evictions", "Overflows": "Cache Overflows", "Memory Usage": "Peak Memory Usage"}},
    "Storage": {"first": "Storage", "labels": {"Maximum Storage": "Maximum Storage"}},
    "Heap Blocks": {"pairs": {"exact": "Exact Heap Blocks", "lossy": "Lossy Heap Blocks"}},
    "WAL": {"pairs": {"records": "WAL Records", "fpi": "WAL FPI", "bytes": "WAL Bytes", "full": "WAL Buffers Full"}},
    "Prefetch": {"pairs": {"avg": "Average Prefetch Distance", "max": "Max Prefetch Distance", "capacity": "Prefetch Capacity"}},
    "Memory": {"pairs": {"used": "Memory Used", "allocated": "Memory Allocated"}},
    "Estimates": {"pairs": {"capacity": "Estimated Capacity", "distinct keys": "Estimated Distinct Lookup Keys", "lookups": "Estimated Lookups", "hit percent": "Estimated Hit Percent"}},
}
#: Counters by scope (shared, local, temp); {scope} and {counter} are capitalised.
SCOPED = {"Buffers": ("{scope} {counter} Blocks", ("hit", "read", "dirtied", "written")), "I/O Timings": ("{scope} I/O {counter} Time", ("read", "write"))}
SCOPES = ("Shared", "Local", "Temp")
SORT_GROUPS = ("Full-sort", "Pre-sorted")

#: Order in which properties of a JSON plan are written as text lines.
JSON_ORDER = (
    "Output", "Window", "Sort Key", "Presorted Key", "Group Key", "Hash Key", "Cache Key", "Cache Mode", "Index Cond", "Recheck Cond", "TID Cond", "Merge Cond", "Hash Cond",
    "Join Filter", "One-Time Filter", "Filter", "Run Condition", "Rows Removed by Index Recheck", "Rows Removed by Join Filter", "Rows Removed by Filter", "Heap Fetches",
    "Index Searches", "Order By", "Subplans Removed", "Workers Planned", "Workers Launched", "Function Call", "Table Function Call", "Task Count", "Tasks Shown", "Node",
)
#: Counters that text output leaves out at zero.
ZERO_OMITTED = ("Rows Removed by Filter", "Rows Removed by Join Filter", "Rows Removed by Index Recheck", "Rows Removed by Conflict Filter", "Subplans Removed")
