"""The corpus pipeline: five stages over documents, each one of the operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a
stage returns and gives it to the next one. Every stage gives an empty table for an empty
one and keeps further columns of docs, whatever their names; only the last adds columns,
and one of docs that has such a name gives way there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, pieces, pii, quality, simhash
from tessera.llm.common import documents, forget, staged

MODEL = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects. Null and empty texts have too few words
    and go; repeated rows get one verdict and stay as often as they come."""
    kept = quality.fresh(docs, "__kept")
    return quality.judge(docs, result=kept).filter(F.col(kept)).select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id, nulls last, ties by a
    hash of the row. Null, empty and white-space texts are copies of each other; of rows
    alike in all columns one stays."""
    return simhash.drop_near_duplicates(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced; n_chars follows the new text. A null text stays null
    (n_chars too), texts without such data don't change, repeated rows change alike."""
    rows = pii.replace(docs)
    return rows.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Null and empty texts have no words
    and are never taken; a null source is a source, the last; which of rows alike in id and
    text the cut meets is open."""
    return mixing.mixed_rows(docs)


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids and what these decode to. Null texts count as empty and
    have no pieces; rows stay as often as they come."""
    return pieces.encode(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("surrogates", surrogates),
    ("mix", mixed),
    ("sentencepiece", coded),
]

#: SimHash grouping, collision repair and Viterbi paths have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
