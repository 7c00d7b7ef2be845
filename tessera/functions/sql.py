"""Spark functions over columns of SQL text."""

from __future__ import annotations

import difflib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.arrays import chunked, fields_of, lists, unrolled
from tessera.shipping import ship

from . import lexer
from .layout import body_lines, format_sql, plpgsql_lines

TOKENS = "array<struct<stmt_no:int,ord:int,kind:string,text:string,lower:string,line:int,col:int,leading_blank:boolean,comments:array<string>,trailing_comment:string>>"


def _formatted(text: str | None) -> tuple[str | None, str | None]:
    if text is None:
        return None, None
    try:
        return format_sql(text), None
    except lexer.LexError as e:
        return None, str(e)


@F.pandas_udf(T.StructType([T.StructField("output", T.StringType()), T.StructField("error", T.StringType())]))
def _format(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_formatted(t) for t in texts], columns=["output", "error"], dtype=object)


def format_column(text: Column) -> Column:
    """struct<output, error> of a text: laid out, or why it can't be read. Null for null."""
    return F.when(text.isNotNull(), _format(text))


def format_corpus(files: DataFrame, text: str = "text") -> DataFrame:
    """files plus output, error and changed."""
    ship(files.sparkSession)
    rows = files.withColumn("__f", format_column(F.col(text)))
    return rows.select(*[F.col(f"`{c}`") for c in files.columns], "__f.output", "__f.error", (F.col("__f.output") != F.col(text)).alias("changed"))


@F.pandas_udf(T.StringType())
def _diff(before: pd.Series, after: pd.Series) -> pd.Series:
    def one(a, b):
        if a is None or b is None:
            return None
        return "\n".join(difflib.unified_diff(a.split("\n"), b.split("\n"), "before", "after", n=3, lineterm=""))

    return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)], dtype=object)


def unified_diff(before: Column, after: Column) -> Column:
    """Unified diff of two texts, three lines of context."""
    return _diff(before, after)


def _lexed(text: str | None) -> tuple[list[tuple] | None, str | None]:
    """(tokens, error); a token's values are in the order of TOKENS."""
    if text is None:
        return None, None
    try:
        tokens, rest = lexer.attach(lexer.lex(text))
    except lexer.LexError as e:
        return None, str(e)
    out, n = [], 0
    for k, statement in enumerate(lexer.statements(tokens)):
        for t in statement:
            out.append((k, n, t.kind, t.text, t.lower, t.line, t.col, t.blank_before, [c.text for c in t.comments], t.trailing.text if t.trailing else None))
            n += 1
    for c in rest:
        out.append((-1, n, c.kind, c.text, c.lower, c.line, c.col, c.blank_before, [], None))
        n += 1
    return out, None


#: Texts whose tokens are held as Python objects at a time.
CHUNK = 500
LEXED = f"tokens {TOKENS}, error string"


def _lexed_chunk(texts: list[str | None], kind: pa.StructType) -> pa.StructArray:
    read = [_lexed(t) for t in texts]
    return pa.StructArray.from_arrays([lists([r[0] for r in read], kind.field("tokens").type), pa.array([r[1] for r in read], pa.string())], fields=list(kind))


@F.arrow_udf(fields_of(LEXED))
def _lex_texts(texts: pa.Array) -> pa.Array:
    return chunked(texts, CHUNK, _lexed_chunk, LEXED)


def lexed(text: Column) -> Column:
    """struct<tokens, error> by the exact lexer."""
    return _lex_texts(text)


def sql_tokens(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, stmt_no, ord, kind, text, ...), one row a token; comments hang on tokens."""
    ship(files.sparkSession)
    return unrolled(files.select(key, lexed(F.col(text)).alias("x")), [key], "x.tokens", "ord")


def native_token_rows(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, ord, token, kind, depth, stmt_no) inside the JVM: the lexer's regular part,
    and statements as running sums over a text's tokens."""
    rows = files.select(key, F.posexplode(lexer.native_tokens(F.col(text))).alias("ord", "token"))
    w = Window.partitionBy(key).orderBy("ord")
    step = F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)
    rows = rows.withColumn("depth", F.sum(step).over(w))
    ended = F.sum(F.when((F.col("token") == ";") & (F.col("depth") <= 0), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(key, "ord", "token", lexer.native_kind(F.col("token")).alias("kind"), "depth", F.coalesce(ended, F.lit(0)).cast("int").alias("stmt_no"))


def statement_rows(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, stmt_no, kind, n_tokens, n_comments)."""

    @F.udf("array<struct<stmt_no:int,kind:string,n_tokens:int,n_comments:int>>", useArrow=True)
    def kinds(t: str | None):
        if t is None:
            return []
        try:
            tokens, _ = lexer.attach(lexer.lex(t))
        except lexer.LexError:
            return []
        return [
            {"stmt_no": i, "kind": lexer.statement_kind(s), "n_tokens": len(s), "n_comments": sum(len(x.comments) + (x.trailing is not None) for x in s)} for i, s in enumerate(lexer.statements(tokens))
        ]

    ship(files.sparkSession)
    return unrolled(files.select(key, kinds(F.col(text)).alias("x")), [key], "x", "stmt_no")


@F.pandas_udf(T.StructType([T.StructField("delimiter", T.StringType()), T.StructField("body", T.StringType())]))
def _dollar(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(lexer.split_dollar_quoted(t) if t is not None else None) or (None, None) for t in texts], columns=["delimiter", "body"], dtype=object)


def split_dollar_quoted(text: Column) -> Column:
    """struct<delimiter, body> of one dollar-quoted literal; nulls for anything else."""
    return _dollar(text)


@F.pandas_udf(T.StructType([T.StructField("output", T.StringType()), T.StructField("understood", T.BooleanType())]))
def _plpgsql(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        lines, ok = plpgsql_lines(t) if t is not None else ([], False)
        rows.append(("\n".join(lines) if t is not None else None, ok if t is not None else None))
    return pd.DataFrame(rows, columns=["output", "understood"])


def format_plpgsql(body: Column) -> Column:
    """struct<output, understood> of a PL/pgSQL body."""
    return _plpgsql(body)


@F.pandas_udf(T.StringType())
def _format_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _formatted(t)[0])


def register(spark: SparkSession) -> None:
    """Functions for SQL text: format_sql(text), sql_error(text), split_dollar_quoted(text), format_plpgsql(text)."""
    ship(spark)
    spark.udf.register("format_sql", _format_text)
    spark.udf.register("format_sql_result", _format)
    spark.udf.register("split_dollar_quoted", _dollar)
    spark.udf.register("format_plpgsql", _plpgsql)


__all__ = ["body_lines", "format_column", "format_corpus", "format_plpgsql", "lexed", "native_token_rows", "register", "split_dollar_quoted", "sql_tokens", "statement_rows", "unified_diff"]
