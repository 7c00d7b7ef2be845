"""Queries of the text operators: token statistics over the test tables; what generated.py
writes from the rows of a table is analysed and laid out by the queries there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexer, sql
from tessera.shipping import spread

from . import generated


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", F.size(lexer.native_tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


def keyword_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploded in the scan's stage and pre-aggregated there; only words are shuffled."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    words = docs.select(F.explode(lexer.native_tokens(F.col("text"))).alias("t")).filter(lexer.native_kind(F.col("t")) == "keyword")
    return words.groupBy(F.lower("t").alias("keyword")).agg(F.count("*").alias("n"))


def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role", F.explode(lexer.native_tokens(F.col("text"))).alias("t"))
    return rows.groupBy("role", lexer.native_kind(F.col("t")).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("t").alias("distinct_tokens"))


def comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.size(F.filter(F.split("html", "\n", -1), lambda x: x.rlike("--"))).cast("bigint").alias("n"))


def format_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout of any text changes white space and case only; what can't be lexed has an error and no output."""
    rows = sql.format_corpus(spread(spark.read.parquet(f"{sf_dir}/conversations.parquet")))

    def squeezed(c: str):
        return F.lower(F.regexp_replace(c, r"\s", ""))

    kept = F.when(F.col("error").isNull(), squeezed("output") == squeezed("text")).otherwise(F.col("output").isNull() & F.col("error").startswith("unterminated"))
    return rows.select("conv_id", "turn", kept.alias("kept"))


QUERIES = {f.__name__: f for f in (token_counts, keyword_freq, token_kinds, comment_lines, format_conversations)} | generated.QUERIES

_RX = lexer.NATIVE_TOKEN.replace("'", "''")
_WORDS = ", ".join(f"'{w}'" for w in sorted(lexer.KEYWORDS))
_KIND = f"""case when starts_with(t, '--') then 'line_comment' when starts_with(t, '''') then 'string' when starts_with(t, '"') then 'ident' when regexp_matches(t, '^[0-9]') then 'number'
  when lower(t) in ({_WORDS}) then 'keyword' when regexp_matches(t, '^[A-Za-z_]') then 'ident' when t in ('(', ')', ',', ';', '.', '[', ']') then 'punct' else 'operator' end"""

ORACLES = {
    "token_counts": f"select doc_id, cast(len(regexp_extract_all(text, '{_RX}')) as bigint) as n_tokens from documents",
    "keyword_freq": f"select lower(t) as keyword, count(*) as n from (select unnest(regexp_extract_all(text, '{_RX}')) as t from documents) where lower(t) in ({_WORDS}) group by 1",
    "token_kinds": f"select role, {_KIND} as kind, count(*) as n, count(distinct t) as distinct_tokens from (select role, unnest(regexp_extract_all(text, '{_RX}')) as t from conversations) group by 1, 2",
    "format_conversations": "select conv_id, turn, true as kept from conversations",
    "comment_lines": "select page_id, cast(len(list_filter(string_split(html, chr(10)), lambda x: contains(x, '--'))) as bigint) as n from pages",
}
ORACLES |= generated.ORACLES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
