"""Rows made in Python as Arrow arrays: column by column, without a dictionary a row."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


_PLAIN = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _parted(text: str) -> list[str]:
    """What commas outside angle brackets part."""
    depth, out, start = 0, [], 0
    for i, c in enumerate(text + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return out


def _type(name: str) -> T.DataType:
    kind, _, inner = name.removesuffix(">").partition("<")
    if kind == "array":
        return T.ArrayType(_type(inner))
    if kind == "map":
        return T.MapType(*map(_type, _parted(inner)))
    return fields_of(inner) if kind == "struct" else _PLAIN[name]


@cache
def fields_of(ddl: str) -> T.StructType:
    """Columns as in DDL, read without a session, which workers don't have."""
    return T.StructType([T.StructField(name, _type(kind)) for name, kind in (re.split(r"[: ]", x, maxsplit=1) for x in _parted(ddl))])


@cache
def struct_type(ddl: str) -> pa.StructType:
    return to_arrow_type(fields_of(ddl))


def lists(rows: list[list[tuple] | None], kind: pa.ListType) -> pa.ListArray:
    """Each text's tuples as a list of structs; None gives null."""
    offsets, n = [], 0
    for some in rows:
        offsets.append(None if some is None else n)
        n += len(some or ())
    fields = list(kind.value_type)
    columns = list(zip(*(x for some in rows if some for x in some), strict=True)) or [()] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array([*offsets, n], pa.int32()), values, type=kind)


def chunked(texts: pa.Array, size: int, one: Callable[[list, pa.StructType], pa.Array], ddl: str) -> pa.Array:
    """one(texts, type) over some texts at a time, so that few rows are Python objects at once."""
    kind = struct_type(ddl)
    done = [one(texts.slice(at, size).to_pylist(), kind) for at in range(0, len(texts), size)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def unrolled(rows: DataFrame, keys: list[str], items: str, never_null: str) -> DataFrame:
    """A row for each struct of an array that Python made. Plain inline() would have Spark look
    for empty arrays first, by a filter that it moves down to the scan: all texts would be read
    twice, the first time before they are spread. So the empty ones go behind, by a field that
    is never null."""
    return rows.select(*keys, F.inline_outer(items)).filter(F.col(never_null).isNotNull())
